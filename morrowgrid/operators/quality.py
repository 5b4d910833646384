"""Data-quality audits: DataFrame in, DataFrame out, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cents, r6, rate, share
from .ranges import quantiles_of


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def null_counts(df: DataFrame, cols: list[str] | None = None, only_missing: bool = False) -> DataFrame:
    """(column_name, n_missing) for every column in one aggregation."""
    cols = cols or df.columns
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    long = one.unpivot([], cols, "column_name", "n_missing")
    return long.where("n_missing > 0") if only_missing else long


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (null equals null)."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def key_unique(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null")).withColumn("is_unique", (F.col("n_rows") == F.col("n_keys")).cast("int"))


def domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """Every value with its count and whether it is allowed; nulls don't count."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).withColumn("allowed", F.col("value").isin(allowed).cast("int"))


def impossible(df: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """(rule, n, max_value) of named predicates, from one pass."""
    names = [r[0] for r in rules]
    one = df.agg(*(x for name, p, c in rules for x in (F.count_if(p).alias(f"{name}_n"), F.max(F.col(c).cast("double")).alias(f"{name}_m"))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"{n}_n").alias("n"), F.col(f"{n}_m").alias("max_value")) for n in names))).alias("r")).select("r.*")


def missingness_signal(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Target rate of missing against present values, column by column, from one scan."""
    flags = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().cast("int").alias("missing")) for c in cols))
    return df.select(F.explode(flags).alias("f"), target).groupBy("f.column_name", "f.missing").agg(F.count("*").alias("n"), rate(target).alias("target_rate"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample standard deviation, minimum, exact quartiles and maximum, one row per column."""
    one = df.agg(*(F.struct(F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("std"), F.min(F.col(c).cast("double")).alias("min_value"), F.max(F.col(c).cast("double")).alias("max_value")).alias(c) for c in cols))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in cols))).alias("r"))
    quarters = quantiles_of(df, cols, [0.25, 0.5, 0.75])
    return rows.select("r.column_name", "r.s").join(F.broadcast(quarters), "column_name", "left").select("column_name", "s.n", "s.mean", "s.std", "s.min_value", *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "s.max_value")


def transaction_audit(t: DataFrame) -> DataFrame:
    """Totals, missing customers, cancellations and non-positive lines of a transaction log, in one pass."""
    sale = ~F.col("invoice_no").startswith("C") & F.col("customer_id").isNotNull() & (F.col("quantity") > 0) & (F.col("unit_price") > 0)
    revenue = (F.col("quantity").cast("decimal(18,2)") * cents("unit_price")).cast("decimal(18,2)")
    return t.agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("customer_id").isNull()).alias("n_no_customer"),
        share(F.col("customer_id").isNull()).alias("share_no_customer"),
        F.count_if(F.col("invoice_no").startswith("C")).alias("n_cancelled"),
        F.count_if(F.col("quantity") <= 0).alias("n_bad_quantity"),
        F.count_if(F.col("unit_price") <= 0).alias("n_bad_price"),
        F.count_if(sale).alias("n_clean"),
        F.count_distinct(F.when(sale, F.col("customer_id"))).alias("n_customers"),
        F.sum(F.when(sale, revenue)).cast("double").alias("revenue"),
    )


def expectations(results: list[tuple[str, bool]], df: DataFrame) -> DataFrame:
    """Assertions as a relation."""
    return df.sparkSession.createDataFrame([(n, int(ok)) for n, ok in results], "expectation string, passed int")
