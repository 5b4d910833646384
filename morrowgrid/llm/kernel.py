"""Shared NumPy/Arrow kernels: flat text buffers, word spans, rolling fingerprints.

Everything here works on the raw UTF-8 buffer of an Arrow string array, many
documents at a time, so the cost is a few nanoseconds a byte and no Python
object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Keys of the independent fingerprints, and masks that keep the first 0 to 8 bytes of a little-endian integer.
_PIECE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 2, dtype=np.uint64)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Stands in for a null id inside the operators: null ids order after all others.
NULL_ID = np.iinfo(np.int64).max

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of an odd base modulo 2**64, and their inverses."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (BASE[which], pow(BASE[which], -1, 2**64)):
            a = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                a[done : 2 * done] = a[:done] * U64(step)
                done, step = 2 * done, step * step % 2**64
            out.append(a)
        _powers[which] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    binary = pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(arr: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text has a range of its own."""
    _, off = flat(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, off: np.ndarray, in_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each text's words) of maximal runs of word bytes inside each text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~SPACE[data] if in_word is None else in_word[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:n])
    inner = np.flatnonzero(cut[1:n]) + 1
    both = inner[w[inner] & w[inner - 1]]
    starts = edge[:n] & w
    ends = edge[1:] & w
    starts[both] = True
    ends[both - 1] = True
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte of data as one integer; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """n independent 64-bit fingerprints of each byte span [s, e), alike wherever it stands.

    A span is cut into pieces of eight bytes; each piece is mixed with its number in the span before the pieces are
    summed, so no regular pattern of bytes cancels out, however long the span is.
    """
    at, size = _eights(data), e - s
    lead = at[s] & _MASK[np.minimum(size, 8)]
    out = [mix(lead + key) for key in _PIECE[:n]]
    long = np.flatnonzero(size > 8)
    if len(long):
        more = -(-size[long] // 8) - 1
        number = spread(np.ones(len(long), np.int64), more)
        start = np.repeat(s[long], more) + 8 * number
        piece = at[start] & _MASK[np.minimum(np.repeat(e[long], more) - start, 8)]
        first = np.append(0, np.cumsum(more)[:-1])
        for h, key in zip(out, _PIECE, strict=False):
            h[long] += np.add.reduceat(mix(piece + mix(number.astype(U64) + key)), first)
    return [mix(h + size.astype(U64) * U64(0xA24BAED4963EE407)) for h in out]


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The first of `span_hashes`."""
    return span_hashes(data, s, e, 1)[0]


def rolling(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Fingerprint of every `width` consecutive entries of h (Karp-Rabin); len(h)-width+1 of them."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    p, inv = powers(n + 1, which)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:n], out=c[1:])
    return mix((c[width:] - c[: n - width + 1]) * inv[: n - width + 1] + U64(width))


def whole(off: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n-width+1 windows lie inside one text (off: word offsets of the texts)."""
    ok = np.ones(max(0, n - width + 1), bool)
    inner = off[1:-1]
    for d in range(1, width):
        at = inner - d
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def owner(off: np.ndarray, n: int) -> np.ndarray:
    """The text each of n words belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off)) if n else np.zeros(0, np.int64)


def ids_of(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False), np.int64)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own only where it is unset and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A list of up to this many (id, fingerprint) rows is sent to every executor; a longer one meets the documents in a shuffle.
SMALL_LIST = 500_000


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows whose (id, xxhash64 of the text) is among the distinct rows (id, fp) of bad; columns may have any name."""
    bad = cut(bad.toDF("bad_id", "bad_fp"))
    small = bad.count() <= SMALL_LIST
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(id_col).alias("row_id"), F.xxhash64(named(text_col)).alias("row_fp"))
    same = F.col("row_id").eqNullSafe(F.col("bad_id")) & (F.col("row_fp") == F.col("bad_fp"))
    return rows.join(F.broadcast(bad) if small else bad, same, "left_anti").select("row.*")


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col(f"`{column.replace('`', '``')}`")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; bucket counts follow it, so each bucket stays bounded at any size."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0)


def runs(pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the maximal stretches where pos goes up by one and key stays."""
    if not len(pos):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1] + 1) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(pos)))


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All integers of the ranges lo, lo+1, ... lo+n-1, one range after the other."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.arange(total) + np.repeat(lo - (ends - n), n)


def append_columns(df: DataFrame, text_col: str, make, new: list[tuple[str, object, pa.DataType]], keep: list[str] | None = None, limit: int = 2 << 20) -> DataFrame:
    """df's columns (or `keep`) and the new ones, which replace columns of the same name (in whatever case).

    make(texts) gets a string array of about `limit` bytes and returns one
    sequence or Arrow array for each new column (name, Spark type, Arrow type).
    """
    from pyspark.sql import types as T

    names = {n.lower() for n, _, _ in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    inside = text_col in kept
    at = kept.index(text_col) if inside else len(kept)
    # columns travel under their numbers, so that any name will do
    source = df.select(*(named(c).alias(f"mg_{i}") for i, c in enumerate(kept)), *([] if inside else [named(text_col).alias("mg_text")]))
    out_names, kinds = [*kept, *(n for n, _, _ in new)], [k for _, _, k in new]
    numbers = [f"mg_{i}" for i in range(len(out_names))]
    types = [*(df.schema[c].dataType for c in kept), *(t for _, t, _ in new)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(numbers, types, strict=True)])

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(at), limit):
                part = b.slice(lo, hi - lo)
                made = make(part.column(at))
                cols = [m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *cols], names=numbers)

    return source.mapInArrow(run, schema).select(*(F.col(n).alias(c) for n, c in zip(numbers, out_names, strict=True)))


def fold_tables(df: DataFrame, sections: int, width: int, combine, dtype) -> np.ndarray:
    """Merge (section int, body binary) rows into one table of fixed size, a section at a time, and bring it to the driver."""

    def fold(batches):
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for k, body in zip(b.column("section").to_pylist(), b.column("body").to_pylist(), strict=True):
                a = np.frombuffer(body, dtype)
                acc[k] = combine(acc[k], a) if k in acc else a.copy()
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([a.tobytes() for a in acc.values()], pa.binary())], names=["section", "body"])

    out = np.zeros(sections * width, dtype)
    for row in df.repartition(sections, "section").mapInArrow(fold, "section int, body binary").collect():
        out[row.section * width : (row.section + 1) * width] = np.frombuffer(row.body, dtype)
    return out
