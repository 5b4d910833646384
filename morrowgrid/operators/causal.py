"""Treatment effects: naive, inverse-propensity weighted, matched within a caliper, standardised."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import r6, ratio
from .features import one_hot, standardise
from .profile import density_histogram
from .ranges import with_range


def naive(d: DataFrame) -> DataFrame:
    one = lambda k: ratio(F.sum(F.when(F.col("t") == k, F.col("y").cast("long"))), F.count_if(F.col("t") == k))
    return d.agg(one(1).alias("treated"), one(0).alias("control")).withColumn("effect", F.col("treated") - F.col("control"))


def with_weights(d: DataFrame) -> DataFrame:
    """Stabilised inverse-propensity weights."""
    s = d.agg(ratio(F.sum("t"), F.count("*")).alias("share_t"))
    return d.crossJoin(F.broadcast(s)).withColumn("w", F.when(F.col("t") == 1, F.col("share_t") / F.col("e")).otherwise((1 - F.col("share_t")) / (1 - F.col("e")))).drop("share_t")


def weight_summary(d: DataFrame) -> DataFrame:
    """Effective sample size and range of the weights by treatment."""
    return with_weights(d).groupBy("t").agg(F.count("*").alias("n"), r6(F.sum("w") ** 2 / F.sum(F.col("w") ** 2)).alias("ess"), r6(F.min("w")).alias("min_w"), r6(F.max("w")).alias("max_w"))


def ipw(d: DataFrame) -> DataFrame:
    """Difference of weighted means."""
    one = lambda k: F.sum(F.when(F.col("t") == k, F.col("w") * F.col("y"))) / F.sum(F.when(F.col("t") == k, F.col("w")))
    return with_weights(d).agg(r6(one(1) - one(0)).alias("ate"))


def nearest_treated(d: DataFrame) -> DataFrame:
    """Each control with its nearest treated unit by logit(e), with replacement; ties go to the lower score.

    Distinct scores are few, so neighbours are sought among distinct treated
    scores: an as-of search both ways over range-partitioned scores, where each
    range also gets the nearest treated score on either side of it.
    """
    logit = F.log(F.col("e") / (1 - F.col("e")))
    sd = d.agg(F.stddev_pop(logit).alias("sd"))
    scores = d.groupBy("e").agg(F.max(F.when(F.col("t") == 1, F.col("e"))).alias("te"), F.avg(F.when(F.col("t") == 1, F.col("y").cast("double"))).alias("ty"))
    parts = with_range(scores, "e")
    ends = parts.groupBy("part").agg(F.min("te").alias("lo"), F.max("te").alias("hi"))
    around = ends.select("part", F.last("hi", True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("prev_hi"), F.first("lo", True).over(W.orderBy("part").rowsBetween(1, W.unboundedFollowing)).alias("next_lo"))
    w = W.partitionBy("part").orderBy("e")
    below = F.coalesce(F.last("te", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("prev_hi"))
    above = F.coalesce(F.first("te", True).over(w.rowsBetween(0, W.unboundedFollowing)), F.col("next_lo"))
    near = parts.join(F.broadcast(around), "part").select("e", below.alias("b"), above.alias("a"))
    lg = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    pick = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).when(lg("e") - lg("b") <= lg("a") - lg("e"), F.col("b")).otherwise(F.col("a"))
    found = near.select("e", pick.alias("match_e")).where("match_e is not null").withColumn("dist", F.abs(lg("e") - lg("match_e")))
    outcome = scores.where("te is not null").select(F.col("te").alias("match_e"), F.col("ty").alias("match_y"))
    return d.where("t = 0").join(found, "e").join(outcome, "match_e").crossJoin(F.broadcast(sd))


def caliper_match(d: DataFrame, factor: float = 0.2) -> DataFrame:
    """Mean difference matched treated - control over controls within factor * sd of the logit."""
    m = nearest_treated(d).where(F.col("dist") <= factor * F.col("sd"))
    return m.agg(F.count("*").alias("n_matched"), r6(F.avg(F.col("match_y") - F.col("y"))).alias("atu"))


def _assembled(d: DataFrame, cols: list[str], id_col: str = "id") -> DataFrame:
    z = standardise(d, id_col, cols)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(z).join(d.select(id_col, "t", "y"), id_col)


def propensity(d: DataFrame, cols: list[str]) -> DataFrame:
    """Fitted probability of treatment."""
    a = _assembled(d, cols)
    m = LogisticRegression(featuresCol="features", labelCol="t", regParam=1.0 / max(1, d.count()), standardization=False).fit(a)
    return m.transform(a).select("id", "t", vector_to_array("probability")[1].alias("e"))


def propensity_overlap(d: DataFrame, cols: list[str]) -> DataFrame:
    return propensity(d, cols).groupBy("t").agg(F.count("*").alias("n"), F.min("e").alias("min_e"), F.avg("e").alias("mean_e"), F.max("e").alias("max_e"))


def overlap_histogram(e: DataFrame, bins: int = 40) -> DataFrame:
    """Density of propensities by treatment over common equal-width bins."""
    return density_histogram(e, "e", bins, "t")


def confounders(d: DataFrame, numeric: list[str], zero: str, categorical: dict[str, list]) -> tuple[DataFrame, list[str]]:
    """The matrix to adjust for: numbers as they are, a 0/1 column for zeros of `zero`, and dummies of the categories, first level dropped; and its columns."""
    out = d.withColumn(f"zero_{zero}", (F.col(zero) == 0).cast("double"))
    names = [*numeric, f"zero_{zero}"]
    for c, levels in categorical.items():
        out = one_hot(out, c, levels)
        names += [f"{c}_{v}" for v in sorted(levels)[1:]]
    return out.withColumns({c: F.col(c).cast("double") for c in names}), names


def outcome_model(d: DataFrame, cols: list[str]):
    z = standardise(d, "id", cols).join(d.select("id", F.col("t").cast("double").alias("t"), "y"), "id")
    a = VectorAssembler(inputCols=[*cols, "t"], outputCol="features").transform(z)
    m = LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / max(1, d.count()), standardization=False).fit(a)
    return m, z


def g_computation(d: DataFrame, cols: list[str]) -> DataFrame:
    """Mean predicted outcome with everyone treated less that with no one."""
    m, z = outcome_model(d, cols)
    asm = VectorAssembler(inputCols=[*cols, "t"], outputCol="features")
    mean = lambda k: m.transform(asm.transform(z.withColumn("t", F.lit(k)))).agg(F.avg(vector_to_array("probability")[1]).alias(f"p{int(k)}"))
    return mean(1.0).crossJoin(mean(0.0)).select((F.col("p1") - F.col("p0")).alias("ate"))


def adjusted_odds(d: DataFrame, cols: list[str]) -> DataFrame:
    m, _ = outcome_model(d, cols)
    return d.sparkSession.createDataFrame([(float(np.exp(m.coefficients[len(cols)])),)], "odds_ratio double")


def bootstrap_ipw(d: DataFrame, cols: list[str], replicates: int = 500) -> DataFrame:
    """IPW effect of replicates that reweight rows by Poisson(1) draws from a hash of (id, replicate).

    Each Newton step is one aggregation over all rows and replicates: a row sends
    its terms to the sums of each replicate inside its Arrow batch, so what is
    shuffled is one small matrix a replicate and task.
    """
    z = standardise(d, "id", cols).join(d.select("id", "t", "y"), "id").persist()
    k = len(cols) + 1
    beta, ridge = np.zeros((replicates, k)), np.diag([0.0, *[1.0] * (k - 1)])  # the intercept isn't penalised

    def draws(ids: np.ndarray) -> np.ndarray:
        h = (ids.astype(np.uint64)[:, None] * np.uint64(2654435761) + np.arange(replicates, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53
        return np.searchsorted(np.array([0.36788, 0.73576, 0.9197, 0.98101, 0.99634, 0.99941]), u)

    def sums(batches, b=None, effect=False):
        size = k * k + k if not effect else 4
        acc = np.zeros((replicates, size))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            t, y, w = pdf["t"].to_numpy(float), pdf["y"].to_numpy(float), draws(pdf["id"].to_numpy())
            for r in range(replicates):
                p = 1 / (1 + np.exp(-(x @ b[r])))
                if effect:
                    acc[r] += [(w[:, r] * t / p * y).sum(), (w[:, r] * t / p).sum(), (w[:, r] * (1 - t) / (1 - p) * y).sum(), (w[:, r] * (1 - t) / (1 - p)).sum()]
                else:
                    g = x.T @ (w[:, r] * (t - p))
                    h = (x * (w[:, r] * p * (1 - p))[:, None]).T @ x
                    acc[r] += np.concatenate([g, h.ravel()])
        yield pd.DataFrame({"b": np.repeat(np.arange(replicates), size), "i": np.tile(np.arange(size), replicates), "v": acc.ravel()})

    def gather(b, effect):
        rows = z.mapInPandas(lambda it: sums(it, b, effect), "b int, i int, v double").groupBy("b", "i").agg(F.sum("v").alias("v")).collect()
        size = 4 if effect else k * k + k
        out = np.zeros((replicates, size))
        for r in rows:
            out[r.b, r.i] = r.v
        return out

    for _ in range(25):
        s = gather(beta, False)
        steps = [np.linalg.solve(s[r, k:].reshape(k, k) + ridge, s[r, :k] - ridge @ beta[r]) for r in range(replicates)]
        beta += np.array(steps)
        if np.abs(steps).max() < 1e-8:
            break
    e = gather(beta, True)
    z.unpersist()
    ate = e[:, 0] / e[:, 1] - e[:, 2] / e[:, 3]
    return d.sparkSession.createDataFrame([(float(np.percentile(ate, 2.5)), float(ate.mean()), float(np.percentile(ate, 97.5)))], "low double, mean double, high double")
