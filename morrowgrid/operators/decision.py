"""Campaign decisions: profit by threshold, sensitivity, sizing, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import case_when, r6, ratio
from ..session import cut_lineage
from .ranges import quantiles_of

#: Default economics: cost of a contact, acceptance rate, value of a saved customer.
COST, ACCEPT, VALUE = 50.0, 0.3, 2000.0
ACCEPT_GRID, VALUE_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (500.0, 1000.0, 1500.0, 2000.0, 3000.0)


def breakeven(spark: SparkSession, cost: float = COST, accept: float = ACCEPT, value: float = VALUE) -> DataFrame:
    return spark.range(1).select((F.lit(cost) / (F.lit(accept) * F.lit(value))).alias("threshold"))


def thresholds(spark: SparkSession, n: int = 197) -> DataFrame:
    """0.01, 0.015, ... 0.99, in thousandths so that they are exact."""
    return spark.range(n).select((10 + F.col("id") * 5).alias("milli"), ((10 + F.col("id") * 5) / F.lit(1000.0)).alias("threshold"))


def contacts(s: DataFrame, grid: DataFrame) -> DataFrame:
    """Contacted rows and churners at every threshold.

    Rows are first counted in the gaps between thresholds, so the grid meets a
    few hundred counts and not the rows.
    """
    cells = s.groupBy(F.floor(F.round(F.col("p") * 1000, 6)).cast("long").alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    return F.broadcast(grid).join(cells, F.col("cell") >= F.col("milli"), "left").groupBy("milli", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("contacted"), F.coalesce(F.sum("pos"), F.lit(0)).alias("churners"))


def profit(accept, value, churners, cost, contacted):
    return accept * value * churners - cost * contacted


def profit_curve(s: DataFrame, cost: float = COST, accept: float = ACCEPT, value: float = VALUE) -> DataFrame:
    c = contacts(s, thresholds(s.sparkSession))
    return c.select("threshold", "contacted", "churners", r6(profit(F.lit(accept), F.lit(value), F.col("churners"), F.lit(cost), F.col("contacted"))).alias("profit"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """First maximum of profit."""
    b = curve.agg(F.max(F.struct("profit", (-F.col("threshold")).alias("nt"))).alias("b"))
    return b.select((-F.col("b.nt")).alias("threshold"), F.col("b.profit").alias("profit"))


def policies(s: DataFrame, cost: float = COST, accept: float = ACCEPT, value: float = VALUE) -> DataFrame:
    """Profit of the best threshold, the break-even, 0.5 and everyone, from one pass over score cells."""
    spark = s.sparkSession
    best = best_threshold(profit_curve(s, cost, accept, value)).select(F.lit("optimal").alias("policy"), "threshold")
    named = spark.createDataFrame([("breakeven", cost / (accept * value)), ("half", 0.5), ("everyone", 0.0)], "policy string, threshold double")
    cells = s.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    j = F.broadcast(best.unionByName(named)).join(cells, F.col("p") >= F.col("threshold"), "left")
    return j.groupBy("policy", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("contacted"), F.coalesce(F.sum("pos"), F.lit(0)).alias("churners")).select("policy", "threshold", "contacted", "churners", r6(profit(F.lit(accept), F.lit(value), F.col("churners"), F.lit(cost), F.col("contacted"))).alias("profit"))


def sensitivity(s: DataFrame, cost: float = COST) -> DataFrame:
    """Best threshold and gain over contacting everyone on the acceptance x value grid; rows are aggregated once."""
    spark = s.sparkSession
    c = contacts(s, thresholds(spark))
    grid = spark.createDataFrame([(a, v) for a in ACCEPT_GRID for v in VALUE_GRID], "accept double, value double")
    total = s.agg(F.count("*").alias("all_n"), F.sum(F.col("y").cast("long")).alias("all_pos"))
    j = c.crossJoin(F.broadcast(grid)).withColumn("profit", r6(profit(F.col("accept"), F.col("value"), F.col("churners"), F.lit(cost), F.col("contacted"))))
    b = j.groupBy("accept", "value").agg(F.max(F.struct("profit", (-F.col("threshold")).alias("nt"))).alias("b"))
    everyone = profit(F.col("accept"), F.col("value"), F.col("all_pos"), F.lit(cost), F.col("all_n"))
    return b.crossJoin(F.broadcast(total)).select("accept", "value", (-F.col("b.nt")).alias("threshold"), r6(F.col("b.profit") - everyone).alias("advantage"))


def campaign(s: DataFrame, threshold: float, cost: float = COST, accept: float = ACCEPT, value: float = VALUE) -> DataFrame:
    hit = F.col("p") >= threshold
    a = s.agg(F.count("*").alias("n_customers"), F.count_if(hit).alias("contacted"), F.count_if(hit & (F.col("y") == 1)).alias("reached"), F.sum(F.col("y").cast("long")).alias("churners"))
    budget, saves = cost * F.col("contacted"), accept * F.col("reached")
    gain = saves * value
    return a.select("n_customers", "contacted", "reached", ratio(F.col("reached"), F.col("churners")).alias("reach"), r6(saves).alias("saves"), r6(budget).alias("budget"), r6(gain).alias("value"), r6(gain - budget).alias("profit"), r6(F.try_divide(gain - budget, budget)).alias("roi"))


def segment_profile(rfm: DataFrame, segment: str) -> DataFrame:
    """Medians, size and revenue share of each segment."""
    rfm = cut_lineage(rfm)
    rev = F.sum(F.col("monetary").cast("decimal(18,2)"))
    cols = ("recency", "frequency", "monetary")
    middle = quantiles_of(rfm, cols, [0.5], [segment]).groupBy(segment).agg(*(F.max(F.when(F.col("column_name") == c, r6(F.col("q")[0]))).alias(f"median_{c}") for c in cols))
    g = rfm.groupBy(segment).agg(F.count("*").alias("n"), rev.alias("rev")).join(middle, segment, "left")
    t = g.agg(F.sum("n").alias("tn"), F.sum("rev").alias("tr"))
    return g.crossJoin(F.broadcast(t)).select(segment, "n", "median_recency", "median_frequency", "median_monetary", ratio(F.col("n"), F.col("tn")).alias("customer_share"), ratio(F.col("rev"), F.col("tr")).alias("revenue_share"))


def name_segments(profile: DataFrame) -> DataFrame:
    """Core, recent or hibernating, by median frequency and recency."""
    return profile.withColumn("segment_name", case_when([(F.col("median_frequency") >= 3, "core"), (F.col("median_recency") <= 60, "recent")], "hibernating"))
