"""Exact k-means on integer vectors by filtering kd-trees.

Each partition of the vectors builds kd-trees once, over TREE_ROWS vectors at most, and keeps them in a checkpoint.
A node holds the count of its vectors, their integer sums and their bounding box. A round sends the centroids down
the trees: at each node the candidate nearest to the box's middle stays, and every candidate that is strictly farther
than it from all of the box goes (one corner of the box decides). Where one candidate is left the whole node is
assigned by its count and sums; at a leaf the vectors meet the candidates that are left. All arithmetic is on
integers, so ties and means are exact, and equal for any partitioning.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import cut
from .vectors import as_long, dot, integer_vectors, matrix, summed

#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 64
K, ROUNDS, DIM = 40, 5, 64


class Tree(NamedTuple):
    """x: the vectors, each node's being x[start:stop]; left and right: a node's children (-1: a leaf); node 0 is the root."""

    x: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


_KINDS = (("x", np.int32, 2), ("start", np.int32, 1), ("stop", np.int32, 1), ("left", np.int32, 1), ("right", np.int32, 1), ("low", np.int32, 2), ("high", np.int32, 2), ("total", np.int64, 2))


def build(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
    """The tree and the order its vectors have in it.

    A node is halved at the median of its box's longest side; a node whose vectors are all equal is a leaf of any size.
    """
    order = np.arange(len(x))
    start, stop, left, right, low, high, total = [], [], [], [], [], [], []
    todo = [(0, len(x), -1)]
    while todo:
        a, b, parent = todo.pop()
        part, node = x[order[a:b]], len(start)
        lo, hi = part.min(0), part.max(0)
        for column, value in ((start, a), (stop, b), (left, -1), (right, -1), (low, lo), (high, hi), (total, part.sum(0, dtype=np.int64))):
            column.append(value)
        if parent >= 0:
            (left if left[parent] < 0 else right)[parent] = node
        side = hi.astype(np.int64) - lo
        if b - a > leaf and side.any():
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, side.argmax()], middle)]
            todo += [(a + middle, b, node), (a, a + middle, node)]
    arrays = (np.array(v) for v in (start, stop, left, right, low, high, total))
    return Tree(x[order], *arrays), order


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster of each vector, count and sums of each cluster, vectors that were assigned with a whole node)."""
    k, norm = len(centroids), (centroids.astype(np.int64) ** 2).sum(1)
    cluster = np.empty(len(tree.x), np.int32)
    count, sums, in_leaves, whole = np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64), [], 0
    node, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(node):
        low, high = tree.low[node].astype(np.int64), tree.high[node].astype(np.int64)
        near = np.where(live, norm - dot(low + high, centroids), np.iinfo(np.int64).max).argmin(1)
        for z in np.unique(near):
            at = np.flatnonzero(near == z)
            away = centroids - centroids[z]
            # the corner of the box farthest towards each candidate; it is nearer to z than to the candidate if the rest is positive
            reach = dot(high[at], np.maximum(away, 0)) + dot(low[at], np.minimum(away, 0))
            live[at] &= ~(norm - norm[z] - 2 * reach > 0)
            live[at, z] = True
        left, alone = tree.left[node], live.sum(1) == 1
        for i in np.flatnonzero(alone):
            n, z = node[i], near[i]
            a, b = tree.start[n], tree.stop[n]
            cluster[a:b] = z
            count[z] += b - a
            sums[z] += tree.total[n]
            whole += b - a
        for i in np.flatnonzero(~alone & (left < 0)):
            a, b = tree.start[node[i]], tree.stop[node[i]]
            some = np.flatnonzero(live[i])
            part = tree.x[a : a + 1] if (low[i] == high[i]).all() else tree.x[a:b]
            cluster[a:b] = some[(norm[some] - 2 * dot(part, centroids[some])).argmin(1)]
            in_leaves.append(np.arange(a, b))
        down = np.flatnonzero(~alone & (left >= 0))
        node, live = np.concatenate([left[down], tree.right[node[down]]]), np.concatenate([live[down], live[down]])
    if in_leaves:
        at = np.concatenate(in_leaves)
        at = at[np.argsort(cluster[at], kind="stable")]
        first = np.flatnonzero(np.append(True, cluster[at][1:] != cluster[at][:-1]))
        sums[cluster[at][first]] += np.add.reduceat(tree.x[at].astype(np.int64), first, axis=0)
        count += np.bincount(cluster[at], minlength=k)
    return cluster, count, sums, whole


def _packed(tree: Tree) -> list[bytes]:
    return [np.ascontiguousarray(v, kind).tobytes() for v, (_, kind, _) in zip(tree, _KINDS, strict=True)]


def _unpacked(batch: pa.RecordBatch, i: int, dim: int) -> Tree:
    parts = (np.frombuffer(batch.column(name)[i].as_py(), kind).reshape((-1, dim)[:axes] if axes > 1 else -1) for name, kind, axes in _KINDS)
    return Tree(*parts)


def kd_trees(vectors: DataFrame, dim: int, rows: int = TREE_ROWS) -> DataFrame:
    """One row (ids, binary arrays of the tree) for each `rows` vectors of a partition of (id, x)."""
    kind = vectors.schema["id"].dataType

    def run(batches):
        ids, xs, n = [], [], 0

        def full():
            tree, order = build(np.concatenate(xs))
            own = pa.concat_arrays(ids).take(pa.array(order))
            row = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([row, *(pa.array([b], pa.binary()) for b in _packed(tree))], names=["ids", *(k for k, _, _ in _KINDS)])

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, rows - n)
                at, n = at + part.num_rows, n + part.num_rows
                ids.append(part.column(0))
                xs.append(matrix(part.column(1), dim))
                if n == rows:
                    yield full()
                    ids, xs, n = [], [], 0
        if n:
            yield full()

    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(k, T.BinaryType()) for k, _, _ in _KINDS)])
    return vectors.mapInArrow(run, schema)


def kmeans(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "2:") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of `dim` finite components.

    Centroids start as the k vectors whose sha256 of salt and id is smallest (a null id has none and comes last; rows
    of one id are ordered by their vectors), so k is the number of vectors if there are fewer. Each of `rounds` rounds
    assigns all vectors (ties go to the smaller number) and replaces each centroid that has some by the floor of their
    mean; then they are assigned once more. Repeated rows count each and keep their row. Rows with a null vector, with
    another number of components, or with one that is null or not finite have no row; an empty table gives none. A
    component beyond `vectors.LIMIT` counts as that; a sum beyond a long is null. Other columns aren't read. The driver
    holds k centroids and their sums.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType
    vectors = integer_vectors(df, id_col, vector_col, dim)
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    seeds = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    ends = T.StructType([T.StructField("c", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    centroids = np.array([r.x for r in seeds], np.int64).reshape(len(seeds), dim)
    if not len(seeds):
        return spark.createDataFrame([], T.StructType([*schema.fields, *ends.fields[1:]]))
    trees = cut(kd_trees(vectors, dim))

    def step(centroids: np.ndarray):
        shared = spark.sparkContext.broadcast(centroids)

        def run(batches):
            c = shared.value
            count, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for b in batches:
                for i in range(b.num_rows):
                    _, n, s, _ = filtered(_unpacked(b, i, dim), c)
                    count += n
                    sums += s
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        return summed(trees.mapInArrow(run, "cluster int, n long, sums array<long>"), "cluster", dim)

    for _ in range(rounds):
        for r in step(centroids):
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for b in batches:
            for i in range(b.num_rows):
                tree = _unpacked(b, i, dim)
                cluster, _, _, _ = filtered(tree, shared.value)
                distance = ((tree.x - shared.value[cluster]) ** 2).sum(1)
                ids = b.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=[id_col, "cluster", "distance"])

    assigned = cut(trees.mapInArrow(assign, schema))
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, as_long(s), as_long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, ends)), F.col("cluster") == F.col("c")).drop("c")


def op12_kdtree_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of all embeddings after 5 rounds (see `kmeans` for nulls, ties and repeats)."""
    return kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same in SQL, all distances of a round at once."""
    whole = "[CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding]"
    fine = "len(embedding) = 64 AND list_bool_and([c IS NOT NULL AND isfinite(c) for c in embedding])"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {whole} AS x FROM embeddings WHERE embedding IS NOT NULL AND {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < {K})",
    ]
    for i in range(ROUNDS + 1):
        near = f"SELECT r, vec_id, v.x, k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.x, c{i}.x)]) AS d FROM v, c{i}"
        out.append(f"a{i} AS MATERIALIZED (SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < ROUNDS:
            sums = f"SELECT k, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) t(j) GROUP BY k, j"
            mean = f"SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS x FROM ({sums}) GROUP BY k"
            out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN ({mean}) m ON m.k = c{i}.k)")
    columns = "vec_id, CAST(a.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia"
    return f"WITH {', '.join(out)} SELECT {columns}, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"


ORACLE = _oracle()
