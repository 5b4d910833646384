"""Group rates, bins, pivots, histograms, correlation and ranks."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import cut_bins, edge_bins, r6, rate, ratio, share
from .ranges import in_long, quantiles, quantiles_of, rank_tables, with_ranks


def group_rate(df: DataFrame, by: str, target: str) -> DataFrame:
    """Mean of a 0/1 target and count by group; null groups are left out."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(rate(target).alias("target_rate"), F.count("*").alias("n"))


def group_share(df: DataFrame, by: str, pred: Column) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(share(pred).alias("share"), F.count("*").alias("n"))


def rates_long(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Target rate of every level of several columns in one relation, by one scan and one shuffle."""
    levels = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols))
    return df.select(F.explode(levels).alias("l"), target).where("l.level is not null").groupBy("l.feature", "l.level").agg(rate(target).alias("target_rate"), F.count("*").alias("n"))


def binned_rate(df: DataFrame, col: str, edges: list[float], target: str) -> DataFrame:
    return df.withColumn("bin", cut_bins(F.col(col), edges)).where("bin is not null").groupBy("bin").agg(rate(target).alias("target_rate"), F.count("*").alias("n"))


def quantile_edges(df: DataFrame, col: str, q: int) -> DataFrame:
    """One row: the distinct exact q-quantile edges."""
    return quantiles(df, col, [i / q for i in range(q + 1)]).select(F.array_distinct("q").alias("edges"))


def with_quantile_bins(df: DataFrame, cols: list[str], q: int) -> DataFrame:
    """{col}_bin for several columns, their edges found together."""
    found = quantiles_of(df, cols, [i / q for i in range(q + 1)])
    one = found.agg(*(F.first(F.when(F.col("column_name") == c, F.array_distinct("q")), ignorenulls=True).alias(f"mg_e{i}") for i, c in enumerate(cols)))
    return df.crossJoin(F.broadcast(one)).withColumns({f"{c}_bin": edge_bins(F.col(c), F.col(f"mg_e{i}")) for i, c in enumerate(cols)}).drop(*(f"mg_e{i}" for i in range(len(cols))))


def with_quantile_bin(df: DataFrame, col: str, q: int, name: str = "bin") -> DataFrame:
    """Bin number by exact quantiles, right-closed; the lowest value falls in bin 0 and null stays null."""
    return df.crossJoin(F.broadcast(quantile_edges(df, col, q))).withColumn(name, edge_bins(F.col(col), F.col("edges"))).drop("edges")


def quantile_rate(df: DataFrame, col: str, q: int, target: str) -> DataFrame:
    return with_quantile_bin(df, col, q).where("bin is not null").groupBy("bin").agg(rate(target).alias("target_rate"), F.count("*").alias("n"))


def pivot_rate(df: DataFrame, row: str, col: str, levels: list, target: str) -> DataFrame:
    """Pivot table of mean target; the levels are given, so no extra pass looks for them."""
    d = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    return d.groupBy(row).agg(*(ratio(F.sum(F.when(F.col(col) == v, F.col(target).cast("long"))), F.count(F.when(F.col(col) == v, F.col(target)))).alias(f"{col}_{v}") for v in levels))


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """Contingency table in long form with its empty cells."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = d.groupBy(x, y).agg(F.count("*").alias("n"))
    cells = n.select(x).distinct().crossJoin(F.broadcast(n.select(y).distinct()))
    return cells.join(n, [x, y], "left").select(x, y, F.coalesce("n", F.lit(0)).alias("n"))


def density_histogram(df: DataFrame, col: str, bins: int, by: str, high: Column | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum, density by class; the last bin is closed."""
    c = F.col(col).cast("double")
    d = df.where(c.isNotNull()).select(c.alias("v"), by)
    lim = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = d.crossJoin(F.broadcast(lim)).withColumn("bin", F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)).cast("int"))
    total = F.sum("n").over(W.partitionBy(by))
    return b.groupBy(by, "bin", "lo", "hi").agg(F.count("*").alias("n")).select(by, "bin", "n", r6(F.try_divide(F.col("n").cast("double"), total * width)).alias("density"))


def clipped_histogram(df: DataFrame, col: str, bins: int, by: str, q: float = 0.99) -> DataFrame:
    """Histogram of values clipped above at their q-quantile."""
    top = quantiles(df, col, [q]).select(F.col("q")[0].alias("top"))
    return density_histogram(df.crossJoin(F.broadcast(top)).withColumn(col, F.when(F.col(col).isNotNull(), F.least(F.col(col).cast("double"), F.col("top")))), col, bins, by)


def five_numbers(df: DataFrame, col: str, by: str) -> DataFrame:
    """Box-plot numbers by level: whiskers end at the last point within 1.5 interquartile ranges."""
    d = df.where(F.col(by).isNotNull() & F.col(col).isNotNull())
    q = quantiles(d, col, [0.25, 0.5, 0.75], [by])
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))
    v, reach = F.col(col).cast("double"), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return d.join(q, by).groupBy(by, "q1", "med", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.count_if(~inside).alias("n_outliers")).select(by, "low", r6(F.col("q1")).alias("q1"), r6(F.col("med")).alias("med"), r6(F.col("q3")).alias("q3"), "high", "n_outliers")


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation matrix in long form (upper half and diagonal), one pass."""
    pairs = list(combinations_with_replacement(cols, 2))

    def corr(a: str, b: str) -> Column:
        # over rows that have both; null where one of them is constant
        x, y = F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*(corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), r6(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs))).alias("p")).select("p.*")


def ranked_values(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """(value, n, rank) over the distinct values of a column: rows with the value and its average-tie rank."""
    rank = F.col("mg_total") + 1 - F.col("mg_rank") if desc else F.col("mg_rank")
    return rank_tables(in_long(df, [col])).select(F.col("mg_v").alias("value"), F.col("mg_n").alias("n"), rank.alias("rank"))


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation matrix of average-tie ranks, each column ranked over its own non-null values; all columns are ranked together."""
    ranked = with_ranks(df.select(*cols), cols, [f"rank_{c}" for c in cols])
    return pearson(ranked.select(*(F.col(f"rank_{c}").alias(c) for c in cols)), cols)


def skewness(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected skewness of each column and of its log1p."""
    def adjusted(c: Column) -> Column:
        n = F.count(c).cast("double")
        return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)

    one = df.agg(*(x for c in cols for x in (adjusted(F.col(c).cast("double")).alias(f"{c}_raw"), adjusted(F.log1p(F.col(c).cast("double"))).alias(f"{c}_log"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), r6(F.col(f"{c}_raw")).alias("skew_raw"), r6(F.col(f"{c}_log")).alias("skew_log")) for c in cols))).alias("s")).select("s.*")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
