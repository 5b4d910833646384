"""BPE by speculating and verifying.

Greedy longest matches propose a word's tokens; a NumPy check of every adjacent
pair tells whether byte-pair merging would leave that boundary standing; only
words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .kernel import append_columns, sha, spread

#: How the byte-level pre-tokenizer splits a text (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words kept in a worker's cache before it starts anew, and the longest word that is kept.
CACHE_WORDS, CACHE_LENGTH = 100_000, 64
#: SPLIT for texts of Latin-1 signs only, with its classes of letters, numbers and white space written out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT_LATIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_split_latin = re.compile(SPLIT_LATIN).findall


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 sign, else the next sign from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in visible}, 256
    for b in range(256):
        if chr(b) not in table:
            table[chr(extra)] = b
            extra += 1
    return table


class SpeculativeBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normalizer is read")
        signs = byte_alphabet()
        self.bytes_of = {i: bytes(signs[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        if any(bytes((b,)) not in self.id_of for b in range(256)):
            raise ValueError("a byte has no token")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # every prefix of a token: the token's id, or -1 if it is none itself
        self.prefix = {b[:k]: -1 for b in self.id_of for k in range(1, len(b))} | self.id_of
        self.name_of = {i: str(i) for i in self.bytes_of}
        size = max(self.bytes_of) + 1
        # the bytes of all tokens one after the other, and where each begins
        spelled = [self.bytes_of.get(i, b"") for i in range(size)]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.starts = np.append(0, np.cumsum([len(b) for b in spelled]))
        # rank of each pair's merge, shifted left by 20 bits, and the token it makes
        self.rank: dict[tuple[int, int], int] = {}
        # made[t]: the merge that makes t (-1: a byte); left[t], right[t]: its two parts
        self.made, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = model["vocab"][a], model["vocab"][b]
            t = model["vocab"][a + b]
            self.rank[x, y] = r << 20 | t
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, x, y
        keys = np.array([x << 32 | y for x, y in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], np.array([v >> 20 for v in self.rank.values()])[order]
        self.unreachable = frozenset(t for b, t in self.id_of.items() if self.merge(b) != [t])
        self.split = regex.compile(SPLIT)
        self.start_cache()

    def start_cache(self) -> None:
        # each word's number, the ids of all words one after the other, and where each begins; a word costs one entry of one dict
        self.number = {s: k for k, s in enumerate(self.special)}
        self.codes, self.begin = array("i", self.special.values()), array("q", range(len(self.special) + 1))
        self.long: list[str] = []

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "codes", "begin", "long", "split", "special_split")} | {"pattern": self.special_split and self.special_split.pattern}

    def __setstate__(self, state):
        pattern = state.pop("pattern")
        self.__dict__ |= state
        self.split, self.special_split = regex.compile(SPLIT), regex.compile(pattern) if pattern else None
        self.start_cache()

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost on ties."""
        tok = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(tok) > 40:
            return self._merge_long(tok)
        get, none = self.rank.get, 1 << 60
        near = [get(p, none) for p in zip(tok, tok[1:])]
        while near:
            best = min(near)
            if best == none:
                break
            i, t = near.index(best), best & 0xFFFFF
            tok[i : i + 2] = [t]
            del near[i]
            if i:
                near[i - 1] = get((tok[i - 1], t), none)
            if i < len(near):
                near[i] = get((t, tok[i + 1]), none)
        return tok

    def _merge_long(self, tok: list[int]) -> list[int]:
        """The same with a heap, in O(n log n), for very long words."""
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and nxt[i] < len(tok) and (found := self.rank.get((tok[i], tok[nxt[i]]))):
                heapq.heappush(heap, (found >> 20, i, tok[i], tok[nxt[i]], found & 0xFFFFF))

        for i in range(len(tok) - 1):
            offer(i)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = t, -1, nxt[j]
            if nxt[j] < len(tok):
                prv[nxt[j]] = i
            offer(prv[i])
            offer(i)
        return [t for t in tok if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match, walking the prefixes of the vocabulary."""
        out, i, n, get = [], 0, len(word), self.prefix.get
        while i < n:
            j, best, end = i + 1, -1, i
            while j <= n and (t := get(word[i:j])) is not None:
                if t >= 0:
                    best, end = t, j
                j += 1
            out.append(best)
            i = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a then b keeps the boundary between them.

        Undo the merges on both sides of the boundary, the latest first; the two
        parts that then touch must have no merge that would have come before.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        # a merge across the boundary wins if its rank is below `limit`; on a tie of positions the left one goes first
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            ok[live[hit]] = False
            live = live[~hit]
            x, y = a[live], b[live]
            rx, ry = self.made[x], self.made[y]
            alive = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[alive], x[alive], y[alive], rx[alive], ry[alive]
            undo_left = rx > ry
            l, r = live[undo_left], live[~undo_left]  # noqa: E741
            limit[l] = rx[undo_left]
            a[l] = self.right[x[undo_left]]
            limit[r] = ry[~undo_left] + 1
            b[r] = self.left[y[~undo_left]]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode words into the cache."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        n = np.array([len(p) for p in proposed], np.int64)
        tok = np.fromiter((t for p in proposed for t in p), np.int64, int(n.sum()))
        word = np.repeat(np.arange(len(words)), n)
        same = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(tok[same] << 32 | tok[same + 1], return_inverse=True)
        fine = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = set(word[same[~fine[back]]].tolist())
        if self.unreachable:
            failing |= set(word[np.isin(tok, list(self.unreachable))].tolist())
        for i in failing:
            proposed[i] = self.merge(raw[i])
        self.long += [w for w in words if len(w) > CACHE_LENGTH]
        self.number.update(zip(words, range(len(self.begin) - 1, len(self.begin) - 1 + len(words)), strict=True))
        for p in proposed:
            self.codes.extend(p)
            self.begin.append(len(self.codes))

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split.findall(text)
        return _split_latin(text)

    def words(self, text: str) -> list[str]:
        if self.special_split is None or not any(s in text for s in self.special):
            return self.pieces(text)
        return [w for part in self.special_split.split(text) for w in ([part] if part in self.special else self.pieces(part))]

    def encode_texts(self, texts: list[str | None]) -> list[tuple[np.ndarray, str]]:
        """Each text's ids, as an array and as decimal numbers joined by commas."""
        self.forget()
        split = [self.words(t or "") for t in texts]
        new = set().union(*split) - self.number.keys()
        # long words last, so that they can be cut off again
        self.learn(sorted(new, key=lambda w: (len(w) > CACHE_LENGTH, w)))
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        begin = np.array(self.begin)
        lo, n = begin[words], np.diff(begin)[words]
        codes = np.array(self.codes, np.int32)[spread(lo, n)]
        ends = np.append(0, np.cumsum(n))[np.cumsum([0, *map(len, split)])].tolist()
        parts = [codes[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return [(p, ",".join(map(self.name_of.__getitem__, p.tolist()))) for p in parts]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The decoded text of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        lo = self.starts[ids]
        raw = self.spelling[spread(lo, self.starts[ids + 1] - lo)].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def forget(self) -> None:
        if len(self.number) > CACHE_WORDS:
            self.start_cache()
        if self.long:
            first = min(map(self.number.pop, self.long))
            del self.codes[self.begin[first] :], self.begin[first + 1 :]
            self.long = []

    def encode(self, text: str | None) -> list[int]:
        (ids, _), = self.encode_texts([text])
        return ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def add_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text (null: empty): adds n_tokens, ids_sha256 and decoded_sha256; with_ids also token_ids.

    The decoded text is made from the ids. Empty texts have no token; repeated rows and
    ids each keep their row, and there are no ties to break: merging goes by rank, then
    leftmost. A very long word is merged with a heap. The new columns replace columns of
    the same name. The vocabulary is read on the driver and broadcast; its size is that
    of the vocabulary file. A worker's cache of words is bounded by CACHE_WORDS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(SpeculativeBpe(path))

    def make(texts: pa.Array):
        bpe = shared.value
        n, ids_sha, text_sha, all_ids = [], [], [], []
        for ids, decimal in bpe.encode_texts(texts.to_pylist()):
            n.append(len(ids))
            ids_sha.append(sha(decimal.encode()))
            text_sha.append(sha(bpe.decode_bytes(ids)))
            if with_ids:
                all_ids.append(ids.tolist())
        bpe.forget()
        return (n, ids_sha, text_sha, all_ids)[: 4 if with_ids else 3]

    new = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string()), ("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
    return append_columns(docs, text_col, make, new[: 4 if with_ids else 3], keep, 1 << 18)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of documents; a null text counts as empty, an empty table gives no row."""
    return add_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), keep=["doc_id"])


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (last): the columns of the documents and n_tokens, ids_sha256 and decoded_sha256.

    Every row stays, repeated rows and null ids too; a null or empty text has no token. Extra columns may have any
    name; those called like a new one, in whatever case, are replaced by it. An empty table stays empty.
    """
    return add_tokens(docs, vocabulary_path())
