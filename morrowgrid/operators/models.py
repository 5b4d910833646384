"""Feature pipelines, resampling, distributed models, attribution. Every fitted step sees training rows only. Search: see `search`."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import base_feature
from ..session import cut_lineage
from .features import levels_of, one_hot, stratified_split
from .ranges import medians, with_position

LABEL = "y"


class Encoder:
    """Standardised numbers and one-hot levels (first dropped), fitted on training rows."""

    def __init__(self, numeric: list[str], categorical: list[str]):
        self.numeric, self.categorical = numeric, categorical

    def fit(self, d: DataFrame) -> Encoder:
        s = d.agg(*(x for c in self.numeric for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s")))).first()
        middle = medians(d, self.numeric)
        self.state = {c: (middle[c], s[f"{c}_m"], s[f"{c}_s"] or 1.0) for c in self.numeric}
        self.levels = {c: levels_of(d, c) for c in self.categorical}
        self.names = [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c in self.categorical for v in self.levels[c][1:]]
        return self

    def transform(self, d: DataFrame, keep: list[str]) -> DataFrame:
        num = {f"num__{c}": (F.coalesce(F.col(c).cast("double"), F.lit(q)) - m) / s for c, (q, m, s) in self.state.items()}
        out = d.withColumns(num)
        for c, v in self.levels.items():
            out = one_hot(out, c, v).withColumnsRenamed({f"{c}_{x}": f"cat__{c}_{x}" for x in v[1:]})
        return VectorAssembler(inputCols=self.names, outputCol="features").transform(out).select(*keep, "features")


def logistic(c: float = 1.0, l1: float = 0.0, n: int = 1, weight: str | None = None) -> LogisticRegression:
    """The strength 1/C of the usual convention becomes regParam 1/(C n)."""
    m = LogisticRegression(labelCol=LABEL, regParam=1 / (c * max(n, 1)), elasticNetParam=l1, standardization=False, maxIter=50)
    return m.setWeightCol(weight) if weight else m


def boosted(trees: int = 20, rate: float = 0.1, depth: int = 3, leaves: int | None = None, min_rows: int = 5, subsample: float = 1.0, seed: int = 42, weight: str | None = None) -> GBTClassifier:
    """MLlib's gradient-boosted trees, trained on all rows wherever they are; a leaf budget becomes the depth that can hold it."""
    m = GBTClassifier(labelCol=LABEL, maxIter=trees, stepSize=rate, maxDepth=math.ceil(math.log2(leaves)) if leaves else depth, minInstancesPerNode=min_rows, subsamplingRate=subsample, seed=seed)
    return m.setWeightCol(weight) if weight else m


def smote_counts(d: DataFrame, ratio: float = 1.0) -> DataFrame:
    """How many rows SMOTE makes: floor(ratio * majority) - minority, at least 0."""
    c = d.groupBy(LABEL).agg(F.count("*").alias("n"))
    return c.agg(F.max("n").alias("majority"), F.min("n").alias("minority")).withColumn("n_new", F.greatest(F.floor(ratio * F.col("majority")) - F.col("minority"), F.lit(0)))


def smote(d: DataFrame, key: str, features: list[str], k: int = 5, ratio: float = 1.0) -> DataFrame:
    """Minority rows interpolated towards one of their k nearest minority rows, chosen by hash; d's rows come first."""
    from .cluster import nearest

    c = {r[LABEL]: r["n"] for r in d.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    small = min(c, key=c.get)
    need = max(0, int(ratio * max(c.values())) - c[small])
    m = d.where(F.col(LABEL) == small)
    v = m.select(F.col(key).alias("id"), F.array(*(F.col(f).cast("double") for f in features)).alias("features"))
    near = nearest(v, k + 1).where("rank > 1").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other_id"))).alias("near"))
    # every seed makes its share of the new rows; the remainder goes to the first ones in the order of a hash
    share, rest = divmod(need, max(1, c[small]))
    placed = with_position(near.withColumn("mg_h", F.xxhash64("id")), "mg_h", "id")
    n_copies = F.lit(share) + (F.col("pos") <= rest).cast("int")
    seeds = placed.withColumn("n_copies", n_copies).where("n_copies > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"), "near")
    h = F.pmod(F.xxhash64("id", "copy"), F.lit(1 << 30))
    few = seeds.select("id", "copy", F.col("near")[(h % F.size("near")).cast("int")]["other_id"].alias("other"), (F.pmod(F.xxhash64("copy", "id"), F.lit(1 << 20)) / float(1 << 20)).alias("u"))
    a = m.select(F.col(key).alias("id"), F.array(*(F.col(f).cast("double") for f in features)).alias("fa"))
    b = m.select(F.col(key).alias("other"), F.array(*(F.col(f).cast("double") for f in features)).alias("fb"))
    new = few.join(a, "id").join(b, "other").select(F.zip_with("fa", "fb", lambda x, y: y - x).alias("step"), "fa", "u")
    new = new.select(F.zip_with("fa", "step", lambda x, s: x + s).alias("full"), "fa", "step", "u").select(F.zip_with("fa", F.transform("step", lambda s: s * F.col("u")), lambda x, s: x + s).alias("x"))
    made = new.select(F.lit(None).cast("long").alias(key), *(F.col("x")[i].alias(f) for i, f in enumerate(features)), F.lit(small).cast("int").alias(LABEL))
    return d.select(key, *(F.col(f).cast("double").alias(f) for f in features), LABEL).unionByName(made)


def scores(model, d: DataFrame, key: str) -> DataFrame:
    return model.transform(d).select(key, F.col(LABEL), vector_to_array("probability")[1].alias("p"))


def odds_ratios(d: DataFrame, key: str, enc: tuple[list[str], list[str]]) -> DataFrame:
    e = Encoder(*enc).fit(d)
    m = logistic(n=d.count()).fit(e.transform(d, [key, LABEL]))
    return d.sparkSession.createDataFrame([(n, float(b), float(math.exp(b))) for n, b in zip(e.names, m.coefficients, strict=True)], "feature string, coefficient double, odds_ratio double")


def linear_shap(d: DataFrame, key: str, enc: tuple[list[str], list[str]]) -> DataFrame:
    """(key, feature, x, phi) with phi = coefficient * (x - mean): sums to the margin less its mean."""
    e = Encoder(*enc).fit(d)
    t = e.transform(d, [key, LABEL])
    m = logistic(n=d.count()).fit(t)
    arr = t.select(key, vector_to_array("features").alias("x"))
    mean = arr.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(e.names))))
    parts = F.array(*(F.struct(F.lit(n).alias("feature"), F.col("x")[i].alias("x"), (float(m.coefficients[i]) * (F.col("x")[i] - F.col(f"m{i}"))).alias("phi")) for i, n in enumerate(e.names)))
    return arr.crossJoin(F.broadcast(mean)).select(key, F.explode(parts).alias("s")).select(key, "s.*")


def mean_abs_shap(shap: DataFrame, categorical: list[str]) -> DataFrame:
    return shap.groupBy(base_feature(F.col("feature"), categorical).alias("feature"), F.col("feature").alias("part")).agg(F.avg(F.abs("phi")).alias("m")).groupBy("feature").agg(F.sum("m").alias("importance"))


def train_test(d: DataFrame, key: str, enc: tuple[list[str], list[str]], build) -> DataFrame:
    """Scores of the held-out fifth."""
    s = cut_lineage(stratified_split(d, key, LABEL))
    train, test = s.where("is_test = 0"), s.where("is_test = 1")
    e = Encoder(*enc).fit(train)
    return scores(build(e.transform(train, [key, LABEL])), e.transform(test, [key, LABEL]), key)
