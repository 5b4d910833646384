"""Repeated word windows, exactly: the engine below suffix-array and substring deduplication.

A window is `width` consecutive words of one document. Whole documents are dealt to homes of a few MB by one shuffle
that every step reads again. A method (suffixes or symbols) says which names a text's words give rise to, alike for
equal words, and which name stands for which windows; so equal windows have equal names.

1. ask and tell, once or in rounds: each home sends its distinct names to the buckets of the names, which answer
   which of them occur again anywhere, and which are hot (occur more than HOT times). Windows whose names don't
   occur again end here. A later round asks only for names built on names that do.
2. show: what is left of a home goes to buckets: suffixes with the words around them, to be sorted, or windows as
   96-bit fingerprints, whose two parts come from independent fingerprints of the words. Windows of a hot name are dealt by their own fingerprint instead of the name's, and equal ones
   are merged inside the home first, so a passage that a third of all documents hold sends one row a home and window.
3. the earliest occurrence and its repeats go back to the documents; a repeat that was merged inside a home takes
   its origin from the window it was merged with, which comes back to the same home.

Rows are NumPy arrays packed by bucket; nothing is a row per word.
"""

from __future__ import annotations

from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ids_of, mix, rolling, runs, slices, span_hashes, spread, text_bytes, word_spans
from .kernel import flat as flat_text

#: Text bytes of a home, and those that one bucket of names or of windows stands for.
HOME_BYTES, NAME_BYTES, WINDOW_BYTES = 4 << 20, 32 << 20, 8 << 20
#: A name that occurs more often is hot; a home counts it up to MOST.
HOT, MOST = 1024, (1 << 16) - 1


class Told(NamedTuple):
    """What a home has been told of the names it has asked for, both sorted: the low 32 bits of those that occur again, and
    the low 48 bits of those that are hot.

    Names travel cut, since being told wrongly that a name occurs again only shows more windows than needed. Hot names
    must be the same ones for all homes: names that agree in 48 bits are counted together everywhere.
    """

    again: np.ndarray
    hot: np.ndarray

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each name occurs again, and whether it is hot."""
        again = _among(self.again, names.astype(np.uint32))
        return again, again & _among(self.hot, names & CUT)


#: Bits of a name that travel.
CUT = np.uint64((1 << 48) - 1)


def _among(sorted_ones: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_ones):
        return np.zeros(len(x), bool)
    return sorted_ones[np.minimum(np.searchsorted(sorted_ones, x), len(sorted_ones) - 1)] == x


class Shown(NamedTuple):
    """Runs of windows: the name that stands for them, where it stands, first window, windows; hot: whether the name is."""

    name: np.ndarray
    at: np.ndarray
    first: np.ndarray
    n: np.ndarray
    hot: np.ndarray


class Method(Protocol):
    """How a method names windows; h: word fingerprints of some texts, w_off: offsets of the texts' words."""

    rounds: int
    #: Words of a suffix that its name stands for; 0: windows are compared by fingerprint, not as suffixes.
    suffix: int

    def ask(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told, turn: int) -> np.ndarray: ...

    def show(self, h: np.ndarray, w_off: np.ndarray, width: int, told: Told) -> Shown: ...


_STEPS = ("lo", "src")  # kept as steps from one entry to the next, which compress well


def _pack(bucket: np.ndarray, cols: list[np.ndarray], kinds, schema) -> pa.RecordBatch | None:
    """One row for each bucket, its entries packed as binary arrays; columns of the schema that kinds lacks are null."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    ends = np.append(first[1:], len(b))
    made = {"bucket": pa.array(b[first], pa.int32())}
    for c, (name, kind) in zip(cols, kinds, strict=True):
        c = np.ascontiguousarray(c[order].astype(kind))
        if name in _STEPS:
            c[1:] -= np.where(b[1:] == b[:-1], c[:-1], 0).astype(kind)
        size = c.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        offsets = pa.py_buffer((np.append(first, ends[-1]) * size).astype(np.int32).tobytes())
        made[name] = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(c.tobytes())])
    return pa.RecordBatch.from_arrays([made.get(n, pa.nulls(len(first), pa.binary())) for n in schema], names=list(schema))


def _unpack(table: pa.Table, kinds, having: str | None = None) -> list[np.ndarray]:
    """The entries of all rows (of those where the column `having` isn't null)."""
    if having:
        table = table.filter(table.column(having).is_valid())
    out = []
    for name, kind in kinds:
        parts = [np.frombuffer(x.as_py(), kind) for x in table.column(name) if x.is_valid]
        if name in _STEPS:
            parts = [np.cumsum(x, dtype=kind) for x in parts]
        out.append(np.concatenate(parts) if parts else np.zeros(0, kind))
    return out


def _spark(schema) -> str:
    return ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in schema)


def _table(batches: list[pa.RecordBatch | None], schema) -> pa.Table:
    some = [b for b in batches if b is not None]
    return pa.Table.from_batches(some) if some else pa.table({n: pa.array([], pa.int32() if n == "bucket" else pa.binary()) for n in schema})


def _words(texts: pa.Array, n: int = 1) -> list[np.ndarray]:
    """Offsets of the texts' words, and n independent fingerprints of each word."""
    data, off = flat_text(texts)
    s, e, w_off = word_spans(data, off)
    return [w_off, *span_hashes(data, s, e, n)]


_NAMES = (("low", np.uint32), ("high", np.uint16), ("n", np.uint16), ("home", np.int32))
_TOLD = (("again", np.uint32),)
_HEATED = (("hot", np.uint64),)
_ANSWER = ("bucket", "again", "hot")
_WINDOWS = (("h", np.uint64), ("h2", np.uint32), ("doc", np.int64), ("home", np.int32), ("lo", np.int32), ("src", np.int32), ("origin", np.int64), ("flag", np.uint8))
_SUFFIXES = (("key", np.uint64), ("doc", np.int64), ("home", np.int32), ("lo", np.int32), ("n", np.int32), ("at", np.int32), ("around", np.uint64))
_SHOWN = ("bucket", "h", "h2", "key", "doc", "home", "lo", "src", "origin", "flag", "n", "at", "around")
_MARKS = (("doc", np.int64), ("lo", np.int32), ("n", np.int32), ("origin", np.int64), ("late", np.uint8), ("src", np.int32))
_fields = lambda kinds: ("bucket", *(n for n, _ in kinds))


def repeated_windows(docs: DataFrame, width: int, method: Method, answer, answer_schema: str, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """answer(ids, texts, marks) for all documents, where marks[i] is (starts, windows, origin ids, late) of text i's runs of repeated windows;
    late: whether the words also start earlier.

    every=False marks the windows whose words also start earlier (a smaller id,
    or the same id and an earlier start); every=True marks the earliest one too
    (with its own id as origin), if the words occur again. A null id comes after
    all others; a null text has no words. Rows that share an id are one document
    with several texts: equal starts aren't earlier than each other.
    """
    size = text_bytes(docs, text_col)
    homes, name_buckets, buckets = (max(8, -(-size // b)) for b in (HOME_BYTES, NAME_BYTES, WINDOW_BYTES))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # home deals whole documents out evenly and is a function of id and text; all steps read this one exchange.
    dealt = d.withColumn("home", F.pmod(F.xxhash64("id", "text"), F.lit(homes)).cast("int")).groupBy("home")

    def told_of(table: pa.Table | None) -> Told:
        if table is None or not table.num_rows:
            return Told(np.zeros(0, np.uint32), np.zeros(0, np.uint64))
        (again,), (hot,) = _unpack(table, _TOLD, "again"), _unpack(table, _HEATED, "hot")
        return Told(np.sort(again), np.sort(hot))

    def asking(turn: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table([], _fields(_NAMES))
            told, home, got = told_of(right), left.column("home")[0].as_py(), []
            text = left.column("text").combine_chunks()
            for x, y in slices(text):
                w_off, h = _words(text.slice(x, y - x))
                got.append(np.unique(method.ask(h, w_off, width, told, turn) & CUT, return_counts=True))
            names, back = np.unique(np.concatenate([a for a, _ in got]), return_inverse=True)
            count = np.bincount(back, np.concatenate([n for _, n in got]), len(names))
            bucket = (names % np.uint64(name_buckets)).astype(np.int64)
            return _table([_pack(bucket, [names & np.uint64(0xFFFFFFFF), names >> np.uint64(32), np.minimum(count, MOST), np.full(len(names), home)], _NAMES, _fields(_NAMES))], _fields(_NAMES))

        return ask if turn else lambda left: ask(left, None)

    def tell(table: pa.Table) -> pa.Table:
        low, high, n, home = _unpack(table, _NAMES)
        names = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        order = np.argsort(names, kind="stable")
        names, n, home = names[order], n[order], home[order].astype(np.int64)
        new = np.append(True, names[1:] != names[:-1])
        total = np.add.reduceat(n.astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1] if len(names) else n
        again, hot = total > 1, total > HOT
        return _table([_pack(home[again], [names[again] & np.uint64(0xFFFFFFFF)], _TOLD, _ANSWER), _pack(home[hot], [names[hot]], _HEATED, _ANSWER)], _ANSWER)

    told: DataFrame | None = None
    for turn in range(method.rounds):
        asked = dealt.applyInArrow(asking(turn), _spark(_fields(_NAMES))) if told is None else dealt.cogroup(told.groupBy("bucket")).applyInArrow(asking(turn), _spark(_fields(_NAMES)))
        answered = asked.groupBy("bucket").applyInArrow(tell, _spark(_ANSWER))
        told = answered if told is None else told.unionByName(answered)

    def show(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _table([], _SHOWN)
        told, home = told_of(right), left.column("home")[0].as_py()
        ids, text = ids_of(left.column("id").combine_chunks()), left.column("text").combine_chunks()
        out, seen = [], []
        for x, y in slices(text):
            w_off, h, other = _words(text.slice(x, y - x), 2)
            s = method.show(h, w_off, width, told)
            if not len(s.name):
                continue
            doc = np.searchsorted(w_off, s.first, "right") - 1
            if method.suffix:
                cold = np.flatnonzero(~s.hot)
                out.append(_pack((s.name[cold] % np.uint64(buckets)).astype(np.int64), [s.name[cold], ids[x:y][doc[cold]], np.full(len(cold), home), (s.first - w_off[doc])[cold], s.n[cold], (s.at - s.first)[cold], _around(h, s.at[cold], method.suffix, width)], _SUFFIXES, _SHOWN))
                s, doc = Shown(*(c[s.hot] for c in s)), doc[s.hot]
            at = spread(s.first, s.n)
            one = rolling(h, width)[at]
            bucket = np.where(np.repeat(s.hot, s.n), mix(one), np.repeat(s.name, s.n)) % np.uint64(buckets)
            seen.append((one, rolling(other, width, 1)[at] >> np.uint64(32), ids[x:y][np.repeat(doc, s.n)], at - np.repeat(w_off[doc], s.n), bucket.astype(np.int64)))
        if seen:
            out.append(_merged(*(np.concatenate(c) for c in zip(*seen, strict=True)), home, buckets))
        return _table(out, _SHOWN)

    shown = dealt.cogroup(told.groupBy("bucket")).applyInArrow(show, _spark(_SHOWN))

    def earliest(table: pa.Table) -> pa.Table:
        h, h2, doc, home, lo, src, origin, flag = _unpack(table, _WINDOWS, "h")
        if table.column("bucket")[0].as_py() >= buckets:
            return _marked(doc, home, lo, origin, np.ones(len(doc), np.uint8), src)
        found = [_earliest(h, h2, doc, home, lo, flag, every)]
        if method.suffix:
            key, doc, home, lo, n, at, around = _unpack(table, _SUFFIXES, "key")
            if len(key):
                i, offset, group = suffix_classes(key, around.reshape(len(key), -1), at - n + 1, at)
                found.append(_earliest(group, np.zeros(len(i), np.uint32), doc[i], home[i], lo[i] + at[i] - offset, np.zeros(len(i), np.uint8), every))
        return _marked(*(np.concatenate(c) for c in zip(*found, strict=True)))

    repeats = shown.groupBy("bucket").applyInArrow(earliest, _spark(_fields(_MARKS)))

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, lo, n, origin, late, src = _unpack(right, _MARKS) if right.num_rows else [np.zeros(0, k) for _, k in _MARKS]
        doc, lo, n, origin, late = _follow(doc, lo, n, origin, late, src)
        order = np.argsort(doc, kind="stable")
        doc, lo, n, origin, late = doc[order], lo[order].astype(np.int64), n[order].astype(np.int64), origin[order], late[order]
        ids = ids_of(left.column("id").combine_chunks())
        p, q = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        found = [(lo[a:b], n[a:b], origin[a:b], late[a:b]) for a, b in zip(p, q, strict=True)]
        return answer(left, found)

    return dealt.cogroup(repeats.groupBy("bucket")).applyInArrow(settle, answer_schema)


def _around(h: np.ndarray, at: np.ndarray, suffix: int, width: int) -> np.ndarray:
    """The words after each suffix's own, then those before it, nearest first, as many as a window may reach.

    Words beyond a text's edge don't matter: no window reaches them.
    """
    reach = np.arange(width - suffix)
    padded = np.append(h, np.uint64(0))
    return padded[np.concatenate([np.minimum(at[:, None] + suffix + reach, len(h)), np.maximum(at[:, None] - 1 - reach, -1)], axis=1)]


def suffix_classes(key: np.ndarray, around: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, offset, class) of every window: the suffix stands `offset` words (least to most) after the window's start.

    The suffixes are sorted by their key (their own first words) and the words after it; neighbours are compared for
    their common prefix. They are sorted by the words before them as well, and those neighbours compared. A window with
    the suffix `offset` words in extends left by these and right by the rest of its words: two windows are equal if no
    neighbour between them, in either order, agrees in fewer.
    """
    m, reach = len(key), around.shape[1] // 2

    def order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort([*words.T[::-1], key]) if reach else np.argsort(key, kind="stable")
        common = np.full(m, -1)
        if m > 1:
            agree = np.concatenate([words[by][1:] == words[by][:-1], np.zeros((m - 1, 1), bool)], axis=1)
            common[1:] = np.where(key[by][1:] == key[by][:-1], agree.argmin(1), -1)
        return by, common

    (by_right, right), (by_left, left) = order(around[:, :reach]), order(around[:, reach:])
    out, last = [], 0
    for offset in range(reach + 1):
        live = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(live):
            continue
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[by_right], b[by_left] = np.cumsum(right < reach - offset), np.cumsum(left < offset)
        code, group = np.unique(a[live] * (m + 1) + b[live], return_inverse=True)
        out.append((live, np.full(len(live), offset), group + last))
        last += len(code)
    i, offset, group = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, offset, group.astype(np.uint64)


def _merged(one, two, doc, at, bucket, home: int, buckets: int) -> pa.RecordBatch | None:
    """A home's windows: the earliest of equal ones goes to its bucket; its followers are repeats already and go back."""
    if not len(one):
        return None
    order = np.lexsort((at, doc, two, one))
    one, two, doc, at, bucket = one[order], two[order], doc[order], at[order], bucket[order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    lead = new | ((doc == doc[start]) & (at == at[start]))
    group = np.cumsum(new) - 1
    again = np.bincount(group, ~lead) > 0
    keep = new | ~lead
    out_bucket = np.where(new, bucket, buckets + home)
    origin = np.where(new, doc, doc[start])
    back = np.flatnonzero(keep)
    back = back[np.lexsort((at[back], doc[back]))]
    return _pack(out_bucket[back], [x[back] for x in (one, two, doc, np.full(len(one), home), at, at[start], origin, again[group].astype(np.uint8))], _WINDOWS, _SHOWN)


def _earliest(h, h2, doc, home, lo, flag, every: bool):
    """(doc, home, start, origin, late, src) of the windows to mark among those of a bucket; equal (h, h2): equal windows."""
    order = np.lexsort((lo, doc, h2, h))
    h, h2, doc, home, lo, flag = (x[order] for x in (h, h2, doc, home, lo, flag))
    new = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])) if len(h) else np.zeros(0, bool)
    group, start = np.cumsum(new) - 1, np.flatnonzero(new)
    origin = doc[start][group]
    keep = (doc != origin) | (lo != lo[start][group])
    late = keep.astype(np.uint8)
    if every and len(h):
        # a copy in a row of the same id and start is no other occurrence, but windows merged at home are
        others = np.bincount(group, late) > 0
        keep = keep | others[group] | (np.maximum.reduceat(flag, start)[group] > 0)
    return doc[keep], home[keep], lo[keep], origin[keep], late[keep], np.full(int(keep.sum()), -1, np.int32)


def _marked(doc, home, lo, origin, late, src) -> pa.Table:
    """Marks for the homes, consecutive windows as runs."""
    order = np.lexsort((lo, doc, home))
    doc, home, lo, origin, late, src = (x[order] for x in (doc, home, lo, origin, late, src))
    step = np.where(src < 0, 0, src.astype(np.int64) - lo + (1 << 40)).astype(np.uint64)
    first, n = runs(lo.astype(np.int64), mix(doc.view(np.uint64)) + mix(origin.view(np.uint64) + np.uint64(1)) + (home.astype(np.uint64) << np.uint64(1)) + late + mix(step))
    return _table([_pack(home[first].astype(np.int64), [doc[first], lo[first], n, origin[first], late[first], src[first]], _MARKS, _fields(_MARKS))], _fields(_MARKS))


def _follow(doc, lo, n, origin, late, src):
    """Runs with src >= 0 repeat the windows from src of the document origin: they take the origins of those windows, themselves if there are none."""
    far = src >= 0
    if not far.any():
        return doc, lo, n, origin, late
    lo, n = lo.astype(np.int64), n.astype(np.int64)
    docs = np.unique(doc)
    key = lambda d, p: (np.searchsorted(docs, d).astype(np.int64) << 32) + p
    heads = np.flatnonzero(~far)
    heads = heads[np.argsort(key(doc[heads], lo[heads]), kind="stable")]
    d, at = np.repeat(origin[far], n[far]), spread(src[far].astype(np.int64), n[far])
    first = d.copy()
    if len(heads):
        j = heads[np.maximum(0, np.searchsorted(key(doc[heads], lo[heads]), key(d, at), "right") - 1)]
        first = np.where((doc[j] == d) & (lo[j] <= at) & (at < lo[j] + n[j]), origin[j], d)
    own, pos, after = np.repeat(doc[far], n[far]), spread(lo[far], n[far]), np.repeat(late[far], n[far])
    f, size = runs(pos, mix(own.view(np.uint64)) + mix(first.view(np.uint64) + np.uint64(1)))
    return tuple(np.concatenate([x[~far], y]) for x, y in ((doc, own[f]), (lo, pos[f]), (n, size), (origin, first[f]), (late, after[f])))


def covered(starts: np.ndarray, n: np.ndarray, width: int, words: int) -> np.ndarray:
    """Which of a text's words a window of the runs (first start, windows) covers."""
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, np.minimum(starts, words), 1)
    np.add.at(edge, np.minimum(starts + n - 1 + width, words), -1)
    return np.cumsum(edge)[:words] > 0
