"""Sharding by sampled splitters.

Keys are sampled with a chance in proportion to the record's size, quantiles of
the sample become splitters, records are range-partitioned by them, and ranges
that turn out overfull are subdivided. Whole ranges are then packed into shards
so that the shards' byte counts come out near equal.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import cut, named

#: Expected size of the key sample, and how many ranges each shard is made of.
SAMPLE, RANGES_PER_SHARD = 16384, 64
#: After every id and row.
LAST = 2**63 - 1


def _splitters(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Quantile boundaries (hash, id, row) of the sorted sample: records <= boundary belong left of it.

    A boundary inside a key that fills more than one range keeps its id part, and its row part where one id of that key
    does so too, so that they are subdivided; any other boundary takes the whole key to its left.
    """
    out: set[tuple[int, int, int]] = set()
    span = lambda a, x: np.searchsorted(a, x, "right") - np.searchsorted(a, x, "left")
    for i in np.unique((np.arange(1, n) * len(keys)) // n):
        h, d, u = (int(x) for x in keys[i])
        if span(keys["h"], h) * n <= len(keys):
            out.add((h, LAST, LAST))
            continue
        lo, hi = np.searchsorted(keys["h"], h, "left"), np.searchsorted(keys["h"], h, "right")
        out |= {(h, LAST, LAST)} | ({(h - 1, LAST, LAST)} if h > -(2**63) else set())
        out.add((h, d, u if span(keys["d"][lo:hi], d) * n > len(keys) else LAST))
    return sorted(out)


def assign_shards(records: DataFrame, n_shards: int, id_col: str = "doc_id", size_col: str = "size", key_col: str = "key", sample: int = SAMPLE, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """Add `shard` (0..n_shards-1) and `slot` (gapless from 0 in each shard) to a narrow table of records.

    Law `bytes`: the shards' sums of size_col are near equal. Records of one key
    stay in one shard unless the key alone is larger than a shard. key_col is a
    long, such as a hash of the record. Null ids order last and null sizes count 0; repeated records each take their
    own slot, ties in any order, and are split by the row number that the checkpoint has fixed; an empty table gives no
    rows. Other columns may have any name; `shard` and `slot` are replaced.
    The driver only ever holds the key sample (its expected size is the
    parameter `sample`) and one row for each range.
    """
    kept = F.struct(*(named(c) for c in records.columns if c.lower() not in ("shard", "slot")))
    number = F.coalesce(named(id_col).cast("long"), F.lit(LAST))
    size = F.coalesce(named(size_col), F.lit(0)).cast("long")
    r = cut(records.select(kept.alias("row"), named(key_col).cast("long").alias("mg_h"), number.alias("mg_d"), F.monotonically_increasing_id().alias("mg_u"), size.alias("mg_s")))
    whole = r.agg(F.sum("mg_s").alias("s"), F.max("mg_s").alias("m")).first()
    total, largest = max(1, whole.s or 0), whole.m or 0
    u = F.pmod(F.xxhash64("mg_d", "mg_h", "mg_u", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = r.select("mg_h", "mg_d", "mg_u", F.floor(F.col("mg_s") * F.lit(sample / total) + u).cast("int").alias("k")).where("k > 0")
    rows = drawn.select("mg_h", "mg_d", "mg_u", F.least("k", F.lit(sample)).alias("k")).collect()
    keys = np.array([(x.mg_h, x.mg_d, x.mg_u) for x in rows], dtype=[("h", "i8"), ("d", "i8"), ("u", "i8")])
    keys = np.sort(np.repeat(keys, [x.k for x in rows])) if rows else keys
    bounds = _splitters(keys, n_shards * ranges_per_shard) if len(keys) else []
    ranged = _ranged(r, bounds)
    sums = {x.mg_r: (x.s, x.h0, x.h1) for x in ranged.groupBy("mg_r").agg(F.sum("mg_s").alias("s"), F.min("mg_h").alias("h0"), F.max("mg_h").alias("h1")).collect()}
    # Subdivide what is still overfull: halve the key, id or row interval until its share is small.
    while True:
        target = total // (n_shards * ranges_per_shard)
        limit = target + max(1, target, largest)
        over = [i for i, (s, h0, h1) in sums.items() if s > limit]
        if not over:
            break
        middle = [F.percentile_approx(f"mg_{c}", 0.5).alias(c) for c in "hdu"]
        ends = [f(f"mg_{c}").alias(c + n) for c in "du" for f, n in ((F.min, "0"), (F.max, "1"))]
        marks = ranged.where(F.col("mg_r").isin(over)).groupBy("mg_r").agg(*middle, *ends).collect()
        more = set()
        for m in marks:
            _, h0, h1 = sums[m.mg_r]
            if h0 < h1:
                more.add((min(m.h, h1 - 1), LAST, LAST))
            elif m.d0 < m.d1:
                more.add((h0, min(m.d, m.d1 - 1), LAST))
            elif m.u0 < m.u1:
                more.add((h0, m.d0, min(m.u, m.u1 - 1)))
        if not more - set(bounds):
            break  # single records
        bounds = sorted({*bounds, *more})
        ranged = _ranged(r, bounds)
        sums = {x.mg_r: (x.s, x.h0, x.h1) for x in ranged.groupBy("mg_r").agg(F.sum("mg_s").alias("s"), F.min("mg_h").alias("h0"), F.max("mg_h").alias("h1")).collect()}
    place = _pack(sums, n_shards, total)
    spark = records.sparkSession
    counts = {x.mg_r: x.n for x in ranged.groupBy("mg_r").agg(F.count("*").alias("n")).collect()}
    start, seen = {}, [0] * n_shards
    for i in sorted(counts):
        start[i] = seen[place[i]]
        seen[place[i]] += counts[i]
    table = spark.createDataFrame([(i, place[i], start[i]) for i in sorted(counts)] or [(-1, 0, 0)], "mg_r int, shard int, mg_start long")
    w = W.partitionBy("mg_r").orderBy("mg_h", "mg_d", "mg_u")
    out = ranged.withColumn("mg_n", F.row_number().over(w)).join(F.broadcast(table), "mg_r")
    return out.select("row.*", "shard", (F.col("mg_start") + F.col("mg_n") - 1).alias("slot"))


def _ranged(r: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """mg_r: how many boundaries lie below the record, found by bisection inside Arrow batches."""
    hs = [b[0] for b in bounds]
    both = list(bounds)

    def find(batches):
        import pyarrow as pa

        top = np.array(hs, np.int64)
        low, high = np.searchsorted(top, top, "left"), np.searchsorted(top, top, "right")
        for b in batches:
            h, d, u = (b.column(c).to_numpy() for c in ("mg_h", "mg_d", "mg_u"))
            i = np.searchsorted(top, h, "left")
            for j in np.flatnonzero((i < len(top)) & (top[np.minimum(i, len(top) - 1)] == h)) if len(top) else ():
                i[j] = bisect_left(both, (int(h[j]), int(d[j]), int(u[j])), int(low[i[j]]), int(high[i[j]]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32))], names=[*b.schema.names, "mg_r"])

    return r.mapInArrow(find, T.StructType([*r.schema.fields, T.StructField("mg_r", T.IntegerType())]))


def _pack(sums: dict, n_shards: int, total: int) -> dict[int, int]:
    """Ranges of one key go together unless they exceed a shard; largest first, each to the least full shard."""
    keys: list[list[int]] = []
    for i in sorted(sums):
        if keys and sums[i][1] == sums[keys[-1][-1]][2]:
            keys[-1].append(i)
        else:
            keys.append([i])
    units = [u for k in keys for u in ([k] if sum(sums[i][0] for i in k) <= total // n_shards else [[i] for i in k])]
    full, place = [0] * n_shards, {}
    for unit in sorted(units, key=lambda u: (-sum(sums[i][0] for i in u), u)):
        k = min(range(n_shards), key=lambda j: (full[j], j))
        for i in unit:
            place[i] = k
            full[k] += sums[i][0]
    return place


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; texts never leave the scan.

    The key is a hash of the text, so equal texts meet in one range. A null text
    has size 1 and the CRC of no bytes.
    """
    text = F.col("text")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    return assign_shards(narrow, n_shards).drop("key")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of documents (see `assign_shards` for nulls, ties and repeats)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
