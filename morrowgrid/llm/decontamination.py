"""Benchmark decontamination by greedy string tiling.

Words of a document and of a test item that share a seed (MIN_MATCH words in a
row, compared by rolling Karp-Rabin fingerprints) are joined; the seeds of a
pair lie on diagonals, whose stretches are its maximal matches. The longest
match that overlaps no marked word is marked, again and again, so reordered
passages count too. An item is leaked if enough of its words are marked.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import append_columns, cut, flat, fold_tables, owner, rolling, span_hash, whole, without, word_spans

#: Words of the shortest tile, and the share of an item's words that makes it leaked.
MIN_MATCH, COVERAGE = 5, 0.5
#: Bits of the seed filter that goes to every executor (2 MB, whatever the benchmark's size).
FILTER_BITS = 1 << 24

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, position) of every MIN_MATCH words in a row, lower-cased without punctuation; and words a text."""
    data, off = flat(pc.utf8_lower(texts))
    s, e, w_off = word_spans(data, off, _WORD)
    n = np.diff(w_off)
    h = rolling(span_hash(data, s, e), MIN_MATCH)
    at = np.flatnonzero(whole(w_off, MIN_MATCH, len(s)))
    text = owner(w_off, len(s))[at] if len(at) else np.zeros(0, np.int64)
    return h[at], text, at - w_off[text], n


def matches(hits: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """(words, document position, item position) of every maximal match.

    hits: for each shared seed where it stands in the document and in the item. The item is walked position by
    position with the diagonals that are matching there, so memory follows the document's hits and the item's words, not their product.
    """
    at = {j: np.array(sorted(set(i)), np.int64) for i, js in hits for j in js}
    out, diagonal, since = [], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(d: np.ndarray, start: np.ndarray, j: int) -> None:
        out.extend((j - s + MIN_MATCH - 1, k + s, s) for k, s in zip(d.tolist(), start.tolist(), strict=True))

    for j in sorted({*at, *(k + 1 for k in at)}):
        now = at[j] - j if j in at else np.zeros(0, np.int64)
        place = np.searchsorted(diagonal, now)
        goes_on = np.zeros(len(now), bool)
        if len(diagonal):
            place = np.minimum(place, len(diagonal) - 1)
            goes_on = diagonal[place] == now
        ended = np.ones(len(diagonal), bool)
        ended[place[goes_on]] = False
        close(diagonal[ended], since[ended], j)
        start = np.full(len(now), j)
        start[goes_on] = since[place[goes_on]]
        diagonal, since = now, start
    return out


def tile(hits: list[tuple[list[int], list[int]]], item_words: int) -> tuple[int, int, int]:
    """(marked words, tiles, longest tile) of an item; of equally long matches the one first in the document, then in the item, is marked first."""
    heap = [(-n, i, j) for n, i, j in matches(hits)]
    heapq.heapify(heap)
    used, marked, tiles, longest = set(), bytearray(item_words + 1), 0, 0
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [k for k in range(-n) if i + k not in used and not marked[j + k]]
        if len(free) == -n:
            used.update(range(i, i - n))
            marked[j : j - n] = b"\1" * -n
            tiles += 1
            longest = max(longest, -n)
            continue
        k = 0
        while k < len(free):
            m = k
            while m + 1 < len(free) and free[m + 1] == free[m] + 1:
                m += 1
            if m - k + 1 >= MIN_MATCH:
                heapq.heappush(heap, (-(m - k + 1), i + free[k], j + free[k]))
            k = m + 1
    return sum(marked), tiles, longest


def _listed(h: np.ndarray, text: np.ndarray, pos: np.ndarray, n: int) -> list[pa.Array]:
    """For each of n texts its distinct seeds and the positions of each."""
    order = np.lexsort((pos, h, text))
    h, text, pos = h[order], text[order], pos[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    of_text = pa.array(np.searchsorted(text[first], np.arange(n + 1)), pa.int32())
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(pos, pa.int32()))
    return [pa.ListArray.from_arrays(of_text, pa.array(h[first].view(np.int64), pa.int64())), pa.ListArray.from_arrays(of_text, places)]


_SEEDS = [("mg_h", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("mg_at", T.ArrayType(T.ArrayType(T.IntegerType())), pa.list_(pa.list_(pa.int32())))]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document and leaked item: coverage (marked share of the item's words), n_tiles and longest.

    Items and texts shorter than MIN_MATCH words, null and empty ones match nothing. Repeated rows (same id and
    text) count once; rows that share an id with other texts, and null ids, are documents of their own, told apart
    by mg_fp; items that share an id are told apart by their texts. Only id and text are read, so other columns' names
    don't matter. Ties between matches: see `tile`. Only seeds that pass a filter of fixed size leave the scan.

    An item that is covered enough shares at least `need` of its seed positions, so its commonest seeds (fewer than
    `need` positions) bring up no candidate: a phrase that many items hold doesn't multiply the documents that hold
    it. The tiles of a candidate pair are then laid with all seeds, as lists of positions, never as pairs of them.
    """
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType

    def of_items(texts: pa.Array):
        h, text, pos, n = seeds(texts)
        return [*_listed(h, text, pos, len(texts)), n.tolist()]

    chosen = items.select(F.col(item_col).alias("item_id"), F.xxhash64(item_text).alias("item_fp"), F.col(item_text).alias("mg_text")).dropDuplicates(["item_id", "item_fp"])
    listed = append_columns(chosen, "mg_text", of_items, [*_SEEDS, ("item_words", T.IntegerType(), pa.int32())], ["item_id", "item_fp"])
    seeded = cut(listed.select("item_id", "item_fp", "item_words", F.explode(F.arrays_zip("mg_h", "mg_at")).alias("s")).select("item_id", "item_fp", "item_words", F.col("s.mg_h").alias("mg_h"), F.col("s.mg_at").alias("mg_j")))
    need = F.ceil(F.ceil(F.lit(coverage) * F.col("item_words")) / F.lit(MIN_MATCH))
    common = seeded.groupBy("mg_h").agg(F.count("*").alias("mg_n"))
    so_far = F.sum(F.size("mg_j")).over(W.partitionBy("item_id", "item_fp").orderBy(F.col("mg_n").desc(), "mg_h").rowsBetween(W.unboundedPreceding, 0))
    leading = seeded.join(common, "mg_h").withColumn("mg_sum", so_far).where(F.col("mg_sum") >= need).select("item_id", "item_fp", "mg_h")

    width, sections = FILTER_BITS // 8 // 64, 64
    shift = np.uint64(64 - FILTER_BITS.bit_length() + 1)

    def bits(batches):
        table = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64) >> shift
            np.bitwise_or.at(table, (h >> np.uint64(3)).astype(np.int64), (1 << (h & np.uint64(7))).astype(np.uint8))
        parts = table.reshape(sections, width)
        live = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[k].tobytes() for k in live], pa.binary())], names=["section", "body"])

    table = fold_tables(seeded.select("mg_h").mapInArrow(bits, "section int, body binary"), sections, width, np.bitwise_or, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def of_docs(texts: pa.Array):
        h, text, pos, _ = seeds(texts)
        k = h >> shift
        hit = np.flatnonzero((shared.value[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1)
        return _listed(h[hit], text[hit], pos[hit], len(texts))

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mg_fp"), F.col(text_col).alias("mg_text"))
    found = cut(append_columns(source, "mg_text", of_docs, _SEEDS, ["doc_id", "mg_fp"]).where(F.size("mg_h") > 0))
    candidates = found.select("doc_id", "mg_fp", F.explode("mg_h").alias("mg_h")).join(leading, "mg_h").select("doc_id", "mg_fp", "item_id", "item_fp").distinct()
    c = cut(candidates).select(F.col("doc_id").alias("c_id"), F.col("mg_fp").alias("c_fp"), F.col("item_id").alias("c_item"), F.col("item_fp").alias("c_ifp"))
    own = found.dropDuplicates(["doc_id", "mg_fp"]).join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("mg_fp") == F.col("c_fp")))
    doc_seeds = own.select("doc_id", "mg_fp", "c_item", "c_ifp", F.explode(F.arrays_zip("mg_h", "mg_at")).alias("s")).select("doc_id", "mg_fp", "c_item", "c_ifp", F.col("s.mg_h").alias("d_h"), F.col("s.mg_at").alias("mg_i"))
    both = doc_seeds.join(seeded, F.col("c_item").eqNullSafe(F.col("item_id")) & (F.col("c_ifp") == F.col("item_fp")) & (F.col("d_h") == F.col("mg_h")))
    pairs = both.groupBy("doc_id", "mg_fp", "item_id", "item_fp", "item_words").agg(F.collect_list(F.struct("mg_i", "mg_j")).alias("mg_hits"))

    def tiled(batches):
        for b in batches:
            words = b.column("item_words").to_pylist()
            rows = [tile([(x["mg_i"], x["mg_j"]) for x in b.column("mg_hits")[i].as_py()], n) for i, n in enumerate(words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mg_fp"), b.column("item_id"), pa.array([r[0] / n for r, n in zip(rows, words, strict=True)], pa.float64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[id_col, "mg_fp", item_col, "coverage", "n_tiles", "longest"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("mg_fp", T.LongType()), T.StructField(item_col, item_kind), T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType()), T.StructField("longest", T.LongType())])
    return pairs.mapInArrow(tiled, schema).where(F.col("coverage") >= coverage)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item; clean documents, null and empty texts have no row (other cases: see `leaks`)."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("mg_fp")


def drop_leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose text holds a leaked benchmark item go; all others stay, null and empty texts and null ids too.

    Extra columns may have any name. An empty table stays empty.
    """
    return without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", F.col("mg_fp").alias("fp")).distinct())
