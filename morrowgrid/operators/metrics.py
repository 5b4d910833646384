"""Evaluation of scores: ROC, precision-recall, calibration and threshold metrics. Sorting happens over distinct scores only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import edge_bins, r6, ratio
from .ranges import quantiles, with_range


def score_counts(s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positives and rows of each distinct score: partial aggregation shrinks the data before anything is ordered."""
    return s.groupBy(*(by or []), "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))


def cumulative(s: DataFrame) -> DataFrame:
    """tp and fp at every threshold p (scores >= p), with class totals.

    Scores are range-partitioned in descending order and each range adds the
    counts of those before it, so no single task takes all distinct scores.
    """
    c = with_range(score_counts(s), "p", desc=True)
    sizes = c.groupBy("part").agg(F.sum("pos").alias("sp"), F.sum("n").alias("sn"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    off = sizes.select("part", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("op"), F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("on"))
    total = sizes.agg(F.sum("sp").alias("tot_pos"), F.sum("sn").alias("tot_n"))
    w = W.partitionBy("part").orderBy(F.col("p").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = c.join(F.broadcast(off), "part").crossJoin(F.broadcast(total))
    tp, m = F.col("op") + F.sum("pos").over(w), F.col("on") + F.sum("n").over(w)
    return d.select("p", "pos", "n", tp.alias("tp"), (m - tp).alias("fp"), "tot_pos", (F.col("tot_n") - F.col("tot_pos")).alias("tot_neg"))


def roc_points(s: DataFrame) -> DataFrame:
    return cumulative(s).select("p", ratio(F.col("fp"), F.col("tot_neg")).alias("fpr"), ratio(F.col("tp"), F.col("tot_pos")).alias("tpr"))


def roc_auc(s: DataFrame) -> DataFrame:
    """Area under the ROC curve in exact integer half-pairs, and the Gini coefficient."""
    c = cumulative(s)
    neg = F.col("n") - F.col("pos")
    # a positive beats the negatives below it and half beats those of its own score
    pairs = F.sum((F.col("pos") * (2 * (F.col("tot_neg") - F.col("fp")) + neg)).cast("decimal(38,0)"))
    a = c.groupBy("tot_pos", "tot_neg").agg(pairs.alias("pairs")).select(ratio(F.col("pairs"), F.lit(2.0) * F.col("tot_pos") * F.col("tot_neg")).alias("auc"))
    return a.select("auc", (2 * F.col("auc") - 1).alias("gini"))


def pr_points(s: DataFrame) -> DataFrame:
    c = cumulative(s)
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tot_pos"))
    return c.select("p", prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec + 1e-12)).alias("f1"))


def average_precision(s: DataFrame) -> DataFrame:
    """Sum of recall steps times precision."""
    c = cumulative(s)
    return c.agg(r6(F.sum(F.col("pos").cast("double") / F.col("tot_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("avg_precision"))


def f1_optimal(s: DataFrame) -> DataFrame:
    """The threshold of the best F1; the lowest one on ties."""
    b = pr_points(s).agg(F.max(F.struct("f1", (-F.col("p")).alias("np"))).alias("b"))
    return b.select((-F.col("b.np")).alias("threshold"), r6(F.col("b.f1")).alias("f1"))


def brier(s: DataFrame) -> DataFrame:
    return s.agg(r6(F.avg((F.col("p") - F.col("y")) ** 2)).alias("brier"))


def confusion(s: DataFrame, threshold: float = 0.5) -> DataFrame:
    return s.groupBy("y", (F.col("p") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(s: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy, macro and weighted rows, from four counts."""
    hit = F.col("p") >= threshold
    one = s.agg(F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if((F.col("y") == 0) & hit).alias("fp"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"), F.count_if((F.col("y") == 0) & ~hit).alias("tn"))

    def row(name: str, tp: str, fp: str, fn: str, support):
        p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), F.try_divide(2.0 * p * r, p + r).alias("f1"), support.alias("support"))

    n0, n1 = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    two = one.select(row("0", "tn", "fn", "fp", n0).alias("a"), row("1", "tp", "fp", "fn", n1).alias("b"), ratio(F.col("tp") + F.col("tn"), n0 + n1).alias("acc"), (n0 + n1).alias("n"))
    mean = lambda c: (F.col(f"a.{c}") + F.col(f"b.{c}")) / 2
    wmean = lambda c: (F.col(f"a.{c}") * F.col("a.support") + F.col(f"b.{c}") * F.col("b.support")) / F.col("n")
    extra = [F.struct(F.lit("accuracy").alias("label"), *(F.col("acc").alias(c) for c in ("precision", "recall", "f1")), F.col("n").alias("support"))]
    extra += [F.struct(F.lit(name).alias("label"), *(f(c).alias(c) for c in ("precision", "recall", "f1")), F.col("n").alias("support")) for name, f in (("macro", mean), ("weighted", wmean))]
    return two.select(F.explode(F.array(F.col("a"), F.col("b"), *extra)).alias("r")).select("r.label", *(r6(F.col(f"r.{c}")).alias(c) for c in ("precision", "recall", "f1")), "r.support")


def reliability(s: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins; empty bins have no row."""
    e = quantiles(s, "p", [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))
    b = s.crossJoin(F.broadcast(e)).withColumn("bin", edge_bins(F.col("p"), F.col("edges")))
    return b.groupBy("bin").agg(r6(F.avg("p")).alias("mean_p"), ratio(F.sum("y"), F.count("*")).alias("rate"), F.count("*").alias("n"))


def mean_vs_prevalence(s: DataFrame) -> DataFrame:
    return s.agg(r6(F.avg("p")).alias("mean_p"), ratio(F.sum("y"), F.count("*")).alias("prevalence"))
