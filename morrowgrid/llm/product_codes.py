"""Compression of vectors to codes by product quantisation, with partial-distance search.

A vector is cut into parts, each replaced by the number of the nearest entry of its position's codebook. The search
takes the components in the order of their variance over the codebook, widest first: after each one, the entry that leads so
far gives a complete distance to beat, and an entry is dropped as soon as its sum over the components so far strictly
exceeds the best complete distance. Masks do this for a block of vectors at once. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import cut
from .vectors import integer_vectors, matrix, summed

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors that are searched at once, and copies of each label's sum that its rows are dealt to.
BLOCK, SALTS = 4096, 16
#: Entries are listed instead of masked once no more than one in so many is left.
SPARSE = 3


def variance_order(book: np.ndarray) -> np.ndarray:
    """The components of a codebook (entries by components), widest variance first; equal ones in their order."""
    b = book.astype(object)
    spread = len(b) * (b * b).sum(0) - b.sum(0) ** 2
    return np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)), np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest entry, lower on ties; squared distance; component differences that were squared) for each row of x."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    kind = np.int32 if x.shape[1] * (2 * int(most)) ** 2 < 2**31 else np.int64
    x, book, order = x.astype(kind), book.astype(kind), variance_order(book)
    none, rows = np.iinfo(kind).max, np.arange(len(x))
    best, work = np.full(len(x), none, kind), 0
    total, live = np.zeros((len(x), len(book)), kind), None
    for at, j in enumerate(order):
        total += (x[:, j, None] - book[:, j]) ** 2
        if live is not None:
            total[~live] = none
        # the entry that leads so far gives a complete distance to beat
        best = np.minimum(best, ((x - book[total.argmin(1)]) ** 2).sum(1, dtype=kind))
        live = total <= best[:, None]
        work += total.size + x.size
        if np.count_nonzero(live) * SPARSE <= live.size:
            break
        total[~live] = 0  # so that nothing overflows; set apart above
    row, entry = np.nonzero(live)
    total = total[row, entry]
    for j in order[at + 1 :]:
        total = total + (x[row, j] - book[entry, j]) ** 2
        work += len(total)
        kept = total <= best[row]
        row, entry, total = row[kept], entry[kept], total[kept]
    # every row still has an entry, that of its best distance; the entries of a row are in order, so the first least one wins
    start = np.searchsorted(row, rows)
    least = np.minimum.reduceat(total, start)
    hit = np.flatnonzero(total == least[row])
    return entry[hit[np.searchsorted(row[hit], rows)]], least.astype(np.int64), work


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), one column a part, of vectors x under books (parts by entries by components)."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.int32), np.empty((len(x), parts), np.int64)
    for a in range(0, len(x), BLOCK):
        for p in range(parts):
            codes[a : a + BLOCK, p], error[a : a + BLOCK, p], _ = nearest(x[a : a + BLOCK, p * width : (p + 1) * width], books[p])
    return codes, error


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts by entries by components) of the rows (id, x) as long as the first one by id.

    They start as the parts of the `entries` smallest ids (null ids last, rows of one id by their vectors; fewer if
    there are fewer); each round assigns all parts and replaces each entry that has some by the floor of their mean.
    The driver holds the codebooks and their sums. Without a vector that can be cut into `parts` there are no entries.
    """
    spark = vectors.sparkSession
    lead = vectors.orderBy(F.col("id").asc_nulls_last(), "x").limit(1).collect()
    dim = len(lead[0].x) if lead else 0
    if not dim or dim % parts:
        return np.zeros((parts, 0, 0), np.int64)
    alike, width = vectors.where(F.size("x") == dim), dim // parts
    seeds = alike.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    books = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches, shared=shared):
            b = shared.value
            n, slots = b.shape[1], b.shape[0] * b.shape[1]
            count, sums = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)
            for batch in batches:
                x = matrix(batch.column(0), dim)
                slot = (encode(x, b)[0] + np.arange(parts) * n).ravel()
                count += np.bincount(slot, minlength=slots)
                cells = x.reshape(-1, width)
                for j in range(width):  # exact: a batch's sums stay far below 2**53
                    sums[:, j] += np.bincount(slot, cells[:, j], slots).astype(np.int64)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

        for r in summed(alike.select("x").mapInArrow(run, "slot int, n long, sums array<long>"), "slot", width):
            books[divmod(r.slot, books.shape[1])] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every vector without a null or non-finite component.

    code: two hex digits a part; error: squared distances to the chosen entries, summed; label_error: errors summed over
    equal labels, nulls together. Ties go to the lower entry. Repeated rows count each and keep their row. Rows with a
    null vector or such a component have no row; an empty table gives none. A vector that isn't as long as the first
    one by id, or can't be cut into `parts`, has a null code and error and counts nowhere. A component beyond
    `vectors.LIMIT` counts as that; a sum beyond a long is null. Other columns aren't read.

    The labels' sums are pre-aggregated where the rows are; each is then copied to SALTS places, over which the rows
    of one label are dealt, so no label's rows meet in one task.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hex digits")
    spark, schema = df.sparkSession, df.schema
    vectors = integer_vectors(df, id_col, vector_col, label_col=label_col)
    books = train_codebooks(vectors.select("id", "x"), parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared, dim = spark.sparkContext.broadcast(books), books.shape[0] * books.shape[2]

    def run(batches):
        for b in batches:
            x = b.column(1)
            fits = np.flatnonzero(x.value_lengths().to_numpy() == dim) if dim else np.zeros(0, np.int64)
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if len(fits):
                codes, errors = encode(matrix(x.take(pa.array(fits)), dim), shared.value)
                text = codes.astype(np.uint8).tobytes().hex()
                code[fits] = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                error[fits] = errors.sum(1).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    fields = [T.StructField("id", schema[id_col].dataType), T.StructField("label", schema[label_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    coded = cut(vectors.mapInArrow(run, T.StructType(fields)))
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    total = total.select(F.col("label").alias("l"), F.when(F.col("s") < F.lit(2**63 - 1), F.col("s")).cast("long").alias("label_error"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    dealt = coded.withColumn("own", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    out = dealt.join(total, F.col("label").eqNullSafe(F.col("l")) & (F.col("own") == F.col("salt")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all embeddings: 16 parts, 64 entries, 2 rounds (see `compress` for nulls, ties and repeats)."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same in SQL, all distances of a round at once."""
    whole = "[CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding]"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {whole} AS x, len(embedding) // {PARTS} AS w FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and([c IS NOT NULL AND isfinite(c) for c in embedding]))",
        f"s AS MATERIALIZED (SELECT r, p, x[p * w + 1 : p * w + w] AS y FROM v, range({PARTS}) t(p))",
        f"f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v QUALIFY e < {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT p, e, y FROM s JOIN f USING (r))",
    ]
    for i in range(ROUNDS + 1):
        near = f"SELECT s.r, s.p, s.y, e, list_sum([(q[1] - q[2]) * (q[1] - q[2]) for q in list_zip(s.y, b.y)]) AS d FROM s JOIN b{i} b ON b.p = s.p"
        out.append(f"a{i} AS MATERIALIZED (SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)")
        if i < ROUNDS:
            sums = f"SELECT p, e, j, sum(y[j]) AS t, count(*) AS n FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS j FROM a{i}) GROUP BY p, e, j"
            mean = f"SELECT p, e, list(CAST((t - ((t % n) + n) % n) / n AS BIGINT) ORDER BY j) AS y FROM ({sums}) GROUP BY p, e"
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM b{i} b LEFT JOIN ({mean}) m ON m.p = b.p AND m.e = b.e)")
    out.append(f"c AS MATERIALIZED (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    books = f"(SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{ROUNDS})"
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {books} AS codebooks_sha256 FROM v JOIN c USING (r)"


ORACLE = _oracle()
