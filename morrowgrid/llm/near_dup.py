"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A shingle's weight is its count in the document times 1 + IDF_SHARE * idf, where idf
is ln(N/df) / ln(1/RARE), at most 1: a shingle in RARE of all documents or fewer is rare,
and nothing rarer weighs more. So only frequent shingles need a count of their own, and
the count-min table that counts them over all documents has the same error at every
size: it is as wide as a document's mean number of shingles asks for, which makes the
mean overcount of a cell at most RARE/4 of the documents. Equal texts are
one node. A node is compared with the leader (smallest node) of each of its band
keys by weighted Jaccard similarity; links join nodes to classes. Where the other
members of a key are then in more than one class, all of its pairs that aren't in
one class are compared, block against block, so no pair with a common key is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import append_columns, cut, flat, fold_tables, mix, owner, rolling, slices, span_hash, spread, without, word_spans

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
IDF_SHARE = 1.0
#: The share of all documents up to which a shingle counts as rare.
RARE = 1 / 256
#: Rows of the count-min table of document frequencies, and bits of its least and largest width (0.5 and 32 MB).
CM_ROWS, CM_BITS = 2, (16, 22)
#: Members that are compared with one copy of a leader's text; a larger group gets more copies.
GROUP = 64
#: Places to which the answer for one label is dealt in the connected components.
SALTS = 32
#: Text bytes and rows of a block of a key's members, where these are compared with one another.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 512

_RNG = np.random.Generator(np.random.PCG64(97))
_R = _RNG.gamma(2, 1, 4096).astype(np.float32) + np.float32(1e-3)
_LOG_C = np.log(_RNG.gamma(2, 1, 4096) + 1e-12).astype(np.float32)
_INV_R, _C_R = (1 / _R).astype(np.float32), (_LOG_C - _R).astype(np.float32)
_ODD = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(44-bit fingerprint, count, offsets by text) of each text's distinct shingles, sorted within the text.

    A text of one to four words is one shingle; one without a word has none.
    """
    data, off = flat(texts)
    s, e, w_off = word_spans(data, off)
    n, words = len(w_off) - 1, np.diff(w_off)
    h = span_hash(data, s, e)
    size = len(h) - SHINGLE + 1
    text = owner(w_off, len(s))
    at = np.flatnonzero(text[:size] == text[SHINGLE - 1 :]) if size > 0 else np.zeros(0, np.int64)
    grams, of = rolling(h, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64), text[at]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        whole = np.array([rolling(h[w_off[i] : w_off[i + 1]], int(words[i]))[0] for i in short], np.uint64)
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, short])
    keys = np.sort(of.astype(np.uint64) << np.uint64(44) | grams >> np.uint64(20))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys & np.uint64((1 << 44) - 1), count, np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(44))


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The count-min cell of each fingerprint in each row of 2**bits cells."""
    return [((h * _ODD[200 + r]) >> np.uint64(64 - bits)).astype(np.int64) for r in range(CM_ROWS)]


def table_bits(n_bytes: int, n_docs: int) -> int:
    """Width of the count-min table: 4 / RARE cells for each shingle of a document of mean length (one in six bytes)."""
    return int(np.clip(np.ceil(np.log2(1 + 4 / RARE * n_bytes / 6 / max(1, n_docs))), *CM_BITS))


def document_frequencies(docs: DataFrame, text_col: str, bits: int) -> np.ndarray:
    """Count-min table of how many documents hold each shingle, over all documents."""
    sections, cols = 64, 1 << bits

    def count(batches):
        total = np.zeros((CM_ROWS, cols), np.int32)
        for b in batches:
            for lo, hi in slices(b.column(0)):
                h, _, _ = shingles(b.column(0).slice(lo, hi - lo))
                for r, c in enumerate(cells(h, bits)):
                    np.add.at(total[r], c, 1)
        parts = total.reshape(sections, -1)
        live = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([parts[k].astype(np.int64).tobytes() for k in live], pa.binary())], names=["section", "body"])

    parts = docs.select(F.col(text_col)).mapInArrow(count, "section int, body binary")
    return fold_tables(parts, sections, CM_ROWS * cols // sections, np.add, np.int64).reshape(CM_ROWS, cols)


def idf_table(table: np.ndarray, n_docs: int) -> np.ndarray:
    """1 + IDF_SHARE * idf of every cell."""
    n = max(1, n_docs)
    return (1 + IDF_SHARE * np.log(n / np.clip(table, max(1.0, n * RARE), n)) / np.log(1 / RARE)).astype(np.float32)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The larger idf belongs to the smaller, so closer, count."""
    best = None
    for r, c in enumerate(cells(h, idf.shape[1].bit_length() - 1)):
        best = idf[r][c] if best is None else np.maximum(best, idf[r][c])
    return count.astype(np.float32) * best


def band_keys(h: np.ndarray, weight: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BANDS keys for each text with a shingle: hashes of ROWS samples (shingle, t) drawn in proportion to weight."""
    live = np.flatnonzero(np.diff(off))
    if not len(live):
        return np.zeros((0, BANDS), np.int64)
    starts, log_w, index = off[live], np.log(weight), np.arange(len(h), dtype=np.uint64)
    keys = np.zeros((len(live), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        x = mix_light(h, k)
        cell = (x >> np.uint64(52)).astype(np.int64)
        beta = ((x >> np.uint64(20)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w * _INV_R[cell] + beta)
        log_a = _C_R[cell] - _R[cell] * (t - beta)
        order = log_a.view(np.int32)
        order = (order ^ ((order >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
        won = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | index, starts) & np.uint64(0xFFFFFFFF)
        won = won.astype(np.int64)
        sample = mix(h[won] ^ (t[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(0xC2B2AE3D27D4EB4F) + sample + np.uint64(k))
    return keys.view(np.int64)


def mix_light(h: np.ndarray, k: int) -> np.ndarray:
    x = (h + np.uint64(k + 1)) * _ODD[k]
    return (x ^ (x >> np.uint64(29))) * _ODD[k + 100]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; a and b are (sorted fingerprints, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    low = np.minimum(a[1][at[same]], b[1][same]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def _verify(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (member, leader) whose weighted Jaccard similarity is high enough.

    A leader's text is copied once for every GROUP members, so no task gets a whole large group.
    """
    sizes = cut(pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("n")))
    salted = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("n")).cast("int").alias("salt"), "member")
    heads = salted.select("leader", "salt").distinct().select("leader", "salt", F.lit(0).alias("role"), F.col("leader").alias("node"))
    rows = heads.unionByName(salted.select("leader", "salt", F.lit(1).alias("role"), F.col("member").alias("node"))).join(texts, "node")
    dealt = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "node")

    def compare(batches):
        now, head = None, None
        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                h, count, off = shingles(part.column("text"))
                w = weights(h, count, idf.value)
                members, leaders = [], []
                for i, (leader, salt, role, node) in enumerate(zip(*(part.column(c).to_pylist() for c in ("leader", "salt", "role", "node")), strict=True)):
                    own = (h[off[i] : off[i + 1]], w[off[i] : off[i + 1]])
                    if role == 0:
                        if now != (leader, salt):
                            now, head = (leader, salt), (own[0].copy(), own[1].copy())
                    elif now == (leader, salt) and weighted_jaccard(head, own) >= similarity:
                        members.append(node)
                        leaders.append(leader)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(leaders, pa.int64())], names=["member", "leader"])

    return dealt.mapInArrow(compare, "member long, leader long")


def _compare_all(nodes: list[int], labels: list[int], bands: np.ndarray, band: int, sides: np.ndarray | None, own: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """The links (member, leader) of a key's members that aren't in one class yet; of pairs that share several keys, those whose first one this is.

    sides: only pairs across the two blocks count. A pair whose weights' sums are too far apart can't be similar.
    """
    name, label = np.array(nodes), np.array(labels)
    size = np.array([len(h) for h, _ in own])
    start = np.append(0, np.cumsum(size))
    h, w = (np.concatenate([x[k] for x in own]) for k in (0, 1))
    total = np.array([float(x.sum(dtype=np.float64)) for _, x in own])
    out = []
    for i in range(len(name) - 1):
        js = np.arange(i + 1, len(name))
        ok = (label[js] != label[i]) & (np.minimum(total[js], total[i]) >= (similarity - 1e-4) * np.maximum(total[js], total[i]))
        if sides is not None:
            ok &= sides[js] != sides[i]
        js = js[ok]
        js = js[(bands[js] == bands[i]).argmax(1) == band]
        if not len(js):
            continue
        at = spread(start[js], size[js])
        a, u = own[i]
        where = np.minimum(np.searchsorted(a, h[at]), len(a) - 1)
        low = np.add.reduceat(np.where(a[where] == h[at], np.minimum(u[where], w[at]), 0), np.append(0, np.cumsum(size[js])[:-1]), dtype=np.float64)
        for j in js[low >= similarity * (total[i] + total[js] - low)]:
            out.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
            label[label == label[j]] = label[i]
    return out


def _exhaust(nodes: DataFrame, many: DataFrame, labels: DataFrame, source: DataFrame, idf, similarity: float) -> DataFrame:
    """The links (member, leader) that the comparison with leaders leaves in keys whose other members are in more than one class.

    Members of a key are dealt to blocks of about BLOCK_BYTES of text and each pair of blocks is a unit of its own,
    so a task's memory is bounded and a large key is spread; no pair is a row.
    """
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "value")).select("node", "size", "band", F.xxhash64("band", "value").alias("key"))
    others = keyed.join(many.where("n > 2"), "key").where("node <> leader").join(labels, "node", "left").select("key", "band", "node", "size", F.coalesce("label", "node").alias("label"))
    others = cut(others)
    mixed = cut(others.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.greatest(F.sum("size") / BLOCK_BYTES, F.count("*") / BLOCK_ROWS)).cast("int").alias("blocks")).where("lo <> hi").select("key", "blocks"))
    own = others.join(mixed, "key").withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q"))))
    units = cut(own.select("key", "band", "node", "label", "i", pair.alias("u")).select("key", "u.p", "u.q", "band", "node", "label", "i"))
    texts = _texts_of(units.select("node").distinct(), nodes, source).join(nodes.select("node", "bands"), "node")
    dealt = units.join(texts, "node").select("key", "p", "q", "node", "band", "label", "i", "bands", "text").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")

    def compare(batches):
        unit, held = None, []

        def done():
            if len(held) < 2:
                return []
            node, band, label, side, bands, own = zip(*held, strict=True)
            return _compare_all(list(node), list(label), np.array(bands), band[0], np.array(side) if unit[1] != unit[2] else None, list(own), similarity)

        for b in batches:
            for lo, hi in slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                h, count, off = shingles(part.column("text"))
                w = weights(h, count, idf.value)
                links = []
                for r, (key, p, q, node, band, label, i, bands) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "p", "q", "node", "band", "label", "i", "bands")), strict=True)):
                    if unit != (key, p, q):
                        links += done()
                        unit, held = (key, p, q), []
                    held.append((node, band, label, i, bands, (h[off[r] : off[r + 1]], w[off[r] : off[r + 1]])))
                yield _pairs(links)
        yield _pairs(done())

    return dealt.mapInArrow(compare, "member long, leader long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["member", "leader"])


def _texts_of(wanted: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes; a row of source that repeats another one's id and text gives the same text once."""
    w = wanted.join(nodes.select("node", "id", "f1", "f2"), "node").select(F.col("node").alias("w_node"), F.col("id").alias("w_id"), F.col("f1").alias("w1"), F.col("f2").alias("w2"))
    same = (F.col("id") == F.col("w_id")) & (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2"))
    return source.join(w, same).select(F.col("w_node").alias("node"), "text")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, by label spreading and pointer jumping."""
    edges = cut(links.select(F.col("member").alias("a"), F.col("leader").alias("b")).union(links.select("leader", "member")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "m").alias("mid"), F.col("label").alias("old"))
        # Each label is asked for once, and its answer is dealt to SALTS places: all nodes of a large class ask for the same one.
        asked = spread.select(F.col("mid").alias("via")).distinct()
        far = asked.join(spread.select(F.col("node").alias("via"), F.col("mid").alias("far")), "via").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = spread.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")).withColumnRenamed("mid", "via")
        new = cut(salted.join(far, ["via", "salt"], "left").select("node", F.least("via", F.coalesce("far", "via")).alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _named(nodes: DataFrame) -> DataFrame:
    """nodes with the key `node`: the id, but where texts share their smallest id, all but the first get a hash instead."""
    shared = cut(nodes.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("f1", "f2")).alias("first")).where("n > 1").select("id", "first"))
    if shared.isEmpty():
        return nodes.withColumn("node", F.col("id"))
    other = F.col("first").isNotNull() & (F.struct("f1", "f2") != F.col("first"))
    return cut(nodes.join(shared, "id", "left").withColumn("node", F.when(other, F.xxhash64("id", "f1", "f2")).otherwise(F.col("id"))).drop("first"))


def _classes(source: DataFrame, similarity: float) -> DataFrame:
    """(id, f1, f2, ok, label, first, n_links) of every row of source (id, text): f1 and f2 are hashes of the text, label
    names its class and first is the smallest id in it; ok: the row has an id and its text a word."""
    whole = source.agg(F.count("text").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    table = document_frequencies(source, "text", table_bits(whole["b"], whole["n"]))
    idf = source.sparkSession.sparkContext.broadcast(idf_table(table, whole["n"]))

    def sign(texts: pa.Array):
        h, count, off = shingles(texts)
        keys = band_keys(h, weights(h, count, idf.value), off)
        some = np.diff(off) > 0
        ends = np.append(0, np.cumsum(some) * BANDS)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel(), pa.int64()))]

    fp = (F.xxhash64("text").alias("f1"), F.xxhash64(F.lit(1), "text").alias("f2"))
    sized = source.select("id", *fp, F.octet_length("text").alias("size"), "text")
    signed = cut(append_columns(sized, "text", sign, [("bands", T.ArrayType(T.LongType()), pa.list_(pa.int64()))], ["id", "f1", "f2", "size"]))
    ok = F.col("id").isNotNull() & (F.size("bands") > 0)
    nodes = cut(signed.where(ok).groupBy("f1", "f2").agg(F.min(F.struct("id", "size", "bands")).alias("m")).select("f1", "f2", F.col("m.id").alias("id"), F.col("m.size").alias("size"), F.col("m.bands").alias("bands")))
    nodes = _named(nodes)
    one = F.transform("bands", lambda b, i: F.xxhash64(i, b))
    two = F.transform("bands", lambda b, i: F.xxhash64(i + BANDS, b, F.col("bands")[(i + 1) % BANDS]))
    keyed = nodes.select("node", F.explode(F.array_distinct(F.concat(one, two))).alias("key"))
    # A written table on this side leaves the join two plain shuffles, so Spark can split a hot key's partition.
    many = cut(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1"))
    pairs = cut(keyed.join(many, "key").where("node > leader").select(F.col("node").alias("member"), "leader").distinct())
    rows = source.where(F.col("id").isNotNull()).dropDuplicates(["id", "text"]) if _repeats(signed) else source
    texts = rows.select("id", *fp, "text")
    found = _texts_of(pairs.select(F.col("member").alias("node")).union(pairs.select("leader")).distinct(), nodes, texts)
    links = cut(_verify(pairs, found, idf, similarity).distinct())
    labels = components(links)
    more = cut(_exhaust(nodes, many, labels, texts, idf, similarity).distinct())
    if not more.isEmpty():
        links = cut(links.union(more).distinct())
        labels = components(links)
    degree = links.select(F.col("member").alias("node")).union(links.select("leader")).groupBy("node").agg(F.count("*").alias("n_links"))
    classed = cut(nodes.select("f1", "f2", "id", "node").join(labels, "node", "left").join(degree, "node", "left").select("f1", "f2", "id", F.coalesce("label", "node").alias("label"), "n_links"))
    firsts = classed.groupBy("label").agg(F.min("id").alias("first"))
    classed = classed.drop("id").join(firsts, "label")
    return signed.select("id", "f1", "f2", ok.alias("ok")).join(classed, ["f1", "f2"], "left").withColumns({"label": F.when(F.col("ok"), F.col("label")), "first": F.when(F.col("ok"), F.col("first")), "n_links": F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")})


def _repeats(signed: DataFrame) -> bool:
    """Whether a row repeats another one's id and text."""
    return not signed.where("id is not null").groupBy("id", "f1", "f2").count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its text's class) and n_links (its text's direct links).

    Equal texts are one node and make no pairs. A null or wordless text and a row with a null id
    stand alone (a null id's class is null). Rows that share an id but not the text are classed by
    their texts. Ties between leaders go to the smallest node. Other columns aren't read; an empty
    table gives no row. Every node meets the smallest node of each of its band keys and of
    each two neighbouring band keys together; then the members of a key that are
    still in different classes meet one another, so every two nodes with a common
    band key are compared or in one class. Texts are taken whole, whatever their length.
    """
    kind = docs.schema[id_col].dataType
    found = _classes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), similarity)
    return found.select(F.col("id").cast(kind).alias(id_col), F.coalesce("first", "id").cast(kind).alias("class_id"), "n_links")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document (see `near_duplicates` for nulls, repeats and ties)."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of texts one row stays, the one with the smallest id, then the smallest hash of its text, then of its columns.

    Null ids, null and wordless texts stay. Texts that share an id are judged each for itself. Extra columns may have
    any name; an empty table stays empty.
    """
    found = cut(_classes(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")), SIMILARITY).where("ok").groupBy("label", "id", "f1").agg(F.count("*").alias("n")))
    best = found.groupBy("label").agg(F.min(F.struct("id", "f1")).alias("best"))
    judged = found.join(best, "label").select("id", "f1", "n", (F.struct("id", "f1") == F.col("best")).alias("stays"))
    kept = without(docs, judged.where("not stays").select("id", "f1").distinct())
    twice = cut(judged.where("stays and n > 1").select("id", "f1"))
    if twice.isEmpty():
        return kept
    rows = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("f1"))
    one = rows.join(twice, ["id", "f1"], "left_semi").groupBy("id", "f1").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return without(kept, twice).unionByName(one.select("row.*"))
