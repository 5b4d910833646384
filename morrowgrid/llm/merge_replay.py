"""Byte-level BPE by replaying the merges over a corpus at once.

The words of a slice of the corpus that aren't known yet are laid out byte by byte in one array with links to each
byte's neighbours. An inverted index tells for each merge where in all words its pair of tokens stands now. The merges
are applied in the order of their ranks, each at all its places together; only the pairs to the left and right of a
place change, and only these enter the index anew. Words never touch, so each ends as if it had been merged alone.
"""

from __future__ import annotations

import base64
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .kernel import append_columns, sha, spread

#: Words that a worker remembers before it starts anew, the longest that is remembered, and text bytes of a slice.
CACHE_WORDS, CACHE_LENGTH, SLICE = 500_000, 64, 4 << 20
#: No merge.
NEVER = np.int32(2**31 - 1)
#: The classes of the patterns of rank files: for all signs, and written out for Latin-1.
CLASSES = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}
LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of Latin-1 signs only, its classes written out."""

    def put(m) -> str:
        if m[0] == r"\S":
            return f"[^{LATIN[chr(92) + 's']}]"
        if m[0][0] != "[":
            return f"[{LATIN[m[0]]}]"
        out = m[0]
        for name, signs in LATIN.items():
            out = out.replace(name, signs)
        return out

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", put, pattern)


class Numbers(dict):
    """Words numbered as they come up; `new` lists those since it was last emptied."""

    def __init__(self):
        self.next, self.new = 0, []

    def __missing__(self, word: str) -> int:
        n = self[word] = self.next
        self.next += 1
        self.new.append(word)
        return n


class Ragged:
    """Short arrays one after the other in one that grows."""

    def __init__(self, kind):
        self.flat, self.used, self.start, self.size, self.rows = np.empty(1 << 16, kind), 0, np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    @staticmethod
    def _fit(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])

    def extend(self, flat: np.ndarray, off: np.ndarray) -> None:
        n, rows = self.used + len(flat), self.rows + len(off) - 1
        self.flat, self.start, self.size = self._fit(self.flat, n), self._fit(self.start, rows), self._fit(self.size, rows)
        self.flat[self.used : n] = flat
        self.start[self.rows : rows], self.size[self.rows : rows] = self.used + off[:-1], np.diff(off)
        self.used, self.rows = n, rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and their sizes."""
        size = self.size[rows]
        return self.flat[spread(self.start[rows], size)], size


def ragged(rows: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.extend(np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(b) for b in rows])))
    return out


class MergeReplay:
    """Encoder and decoder of a rank file: a token's id is its rank, and two tokens merge if their bytes together are one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes((b,)) not in ranks for b in range(256)):
            raise ValueError("a byte has no token")
        self.ranks, self.pattern = ranks, pattern
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        spelled = [b""] * size
        for b, i in ranks.items():
            spelled[i] = b
        self.spelling, self.decimal = ragged(spelled), ragged([b"%d " % i for i in range(size)])
        # every two tokens that make a third: sorted keys, and the token they make
        get = ranks.get
        pairs = [(x << 32 | y, t) for b, t in ranks.items() for k in range(1, len(b)) if (x := get(b[:k])) is not None and (y := get(b[k:])) is not None]
        pairs.sort()
        self.keys, self.makes = (np.array([p[i] for p in pairs], kind) for i, kind in ((0, np.int64), (1, np.int32)))
        first = np.repeat(self.byte, 256)
        self.of_bytes = self.made(first, np.tile(self.byte, 256)).reshape(256, 256)
        self.start()

    def start(self) -> None:
        own = self.pattern
        for name, signs in CLASSES.items():
            own = own.replace(name, signs)
        self.any_words, self.latin_words = regex.compile(own).findall, re.compile(latin_pattern(self.pattern)).findall
        self.forget_all()

    def forget_all(self) -> None:
        self.number, self.known = Numbers(), Ragged(np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("any_words", "latin_words", "number", "known")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.start()

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_words(text)
        return self.latin_words(text)

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, which is also the merge's rank; NEVER if none."""
        key = a.astype(np.int64) << 32 | b
        if not len(self.keys):
            return np.full(len(key), NEVER)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.makes[at], NEVER)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, where each word's begin and end)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n, off = len(data), np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
        token = np.append(self.byte[data], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[off[1:] - 1], before[off[:-1]] = n, n  # entry n stands for no neighbour
        rank = np.full(n + 1, NEVER)  # of the pair that begins at each place
        rank[: n - 1] = self.of_bytes[data[:-1], data[1:]]
        rank[off[1:] - 1] = NEVER
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put places into the index under the ranks of their pairs."""
            r = rank[at]
            live = r != NEVER
            at, r = at[live], r[live]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            first = [0, *cut.tolist()]
            for t, a, b in zip(r[first].tolist(), first, [*first[1:], len(at)], strict=True):
                if t in index:
                    index[t].append(at[a:b])
                else:
                    index[t] = [at[a:b]]
                    heapq.heappush(heap, t)

        enter(np.arange(n, dtype=np.int32))
        alone: dict[int, list[int]] = {}
        while heap:
            t = heapq.heappop(heap)
            parts = index.pop(t)
            at = np.concatenate(parts) if len(parts) > 1 else parts[0]
            at = at[rank[at] == t]
            if len(parts) > 1:
                at.sort()
            if not len(at):
                continue
            if len(at) > 1:
                # of places that overlap the leftmost goes first: every other one of a chain
                chained = np.append(False, after[at[:-1]] == at[1:])
                if chained.any():
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            gone = after[at]
            rest = after[gone]
            # where two places adjoin, the first one's token meets the second's left part for a moment
            meet = np.flatnonzero(rest[:-1] == at[1:])
            brief = at[meet[self.made(np.full(len(meet), t, np.int32), token[at[meet + 1]]) < t]] if len(meet) else meet
            token[at], token[gone], rank[gone] = t, -1, NEVER
            after[at], before[rest] = rest, at
            left = before[at]
            apart = left < n
            apart[1:] &= left[1:] != at[:-1]
            changed = np.concatenate([at, left[apart]])
            follow = after[changed]
            new = np.where(follow < n, self.made(token[changed], token[follow]), NEVER)
            rank[changed] = new
            if len(at) > 1 and ((sooner := new < t).any() or len(brief)):
                # a merge of lower rank has come up: where its word had more places of this one, it would have come in between
                word = np.searchsorted(off, at, "right") - 1
                several = word[1:][word[1:] == word[:-1]]
                for w in np.intersect1d(np.searchsorted(off, np.append(changed[sooner], brief), "right") - 1, several).tolist():
                    rank[off[w] : off[w + 1]] = NEVER
                    alone[w] = self.merge(words[w])
            enter(changed)
        live = token[:n] >= 0
        if not alone:
            return token[:n][live], np.append(0, np.cumsum(live))[off]
        ids = [token[a:b][live[a:b]] for a, b in zip(off[:-1], off[1:], strict=True)]
        for w, own in alone.items():
            ids[w] = np.array(own, np.int32)
        return np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))

    def merge(self, word: bytes) -> list[int]:
        """One word by itself: the lowest rank first, leftmost on ties."""
        ids, ranks = [self.ranks[word[i : i + 1]] for i in range(len(word))], self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        none = int(NEVER)
        near = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while near and (best := min(near)) < none:
            i = near.index(best)
            parts[i : i + 2], ids[i : i + 2] = [parts[i] + parts[i + 1]], [best]
            del near[i]
            for j in (i - 1, i):
                if 0 <= j < len(near):
                    near[j] = ranks.get(parts[j] + parts[j + 1], none)
        return ids

    def learn(self, words: list[str]) -> None:
        """Encode words that come next in the numbering: those that are tokens as such, all others by one replay."""
        raw = [w.encode() for w in words]
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)
        more = np.flatnonzero(whole < 0)
        ids, off = self.replay([raw[i] for i in more.tolist()]) if len(more) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        size = np.ones(len(words), np.int64)
        size[more] = np.diff(off)
        ends = np.append(0, np.cumsum(size))
        flat = np.empty(ends[-1], np.int32)
        flat[ends[:-1][whole >= 0]] = whole[whole >= 0]
        flat[spread(ends[:-1][more], size[more])] = ids
        self.known.extend(flat, ends)

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and end)."""
        split = [self.words(t or "") for t in texts]
        off = np.append(0, np.cumsum([len(w) for w in split])).astype(np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(off[-1]))
        new, self.number.new = self.number.new, []
        if new:
            self.learn(new)
        ids, size = self.known.take(number)
        if len(self.number) > CACHE_WORDS:
            self.forget_all()
        else:
            for w in new:
                if len(w) > CACHE_LENGTH:
                    del self.number[w]
        return ids, np.append(0, np.cumsum(size))[off]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spelling.take(ids)[0].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line has a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def add_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text (null: empty) without special tokens: adds n_tokens, ids_sha256 and decoded_sha256; with_ids also token_ids.

    Each match of the pattern is merged by itself. The decoded bytes are made from the ids. Empty texts have no token;
    repeated rows and ids each keep their row; merges of one rank go from left to right. Texts are taken whole, a word
    of any length too. The new columns replace columns of the same name; an empty table gives no row. The rank file is
    read on the driver and broadcast; its size is that of the file. A worker remembers CACHE_WORDS words at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MergeReplay(read_ranks(path), pattern))

    def make(texts: pa.Array):
        bpe = shared.value
        ids, off = bpe.encode_texts(texts.to_pylist())
        out = [np.diff(off)]
        for spelled, gap in ((bpe.decimal, 1), (bpe.spelling, 0)):
            flat, size = spelled.take(ids)
            ends = np.append(0, np.cumsum(size))[off]
            whole = memoryview(flat)
            out.append([sha(whole[a : max(a, b - gap)]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        return [*out, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))][: 4 if with_ids else 3]

    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string()), ("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
    return append_columns(docs, text_col, make, new[: 4 if with_ids else 3], keep, SLICE)


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of documents; a null text counts as empty, an empty table gives no row."""
    import public_tokenizers

    return add_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
