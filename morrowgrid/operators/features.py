"""RFM features, derived columns, encoders, scalers, imputation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import keyed_hash, r6, ratio
from .ranges import medians, numbered


def rfm(clean: DataFrame) -> DataFrame:
    """Recency, frequency, monetary, tenure, products and order value of each customer; days are elapsed 24-hour periods.

    The snapshot is the day after the last invoice: one row, joined by broadcast.
    """
    snap = clean.agg((F.max("invoice_date") + F.expr("interval 1 day")).alias("snapshot"))
    g = clean.groupBy("customer_id").agg(F.max("invoice_date").alias("last"), F.min("invoice_date").alias("first"), F.count_distinct("invoice_no").alias("frequency"), F.count_distinct("stock_code").alias("n_products"), F.sum("revenue").alias("rev"))
    days = lambda a: F.timestamp_diff("DAY", F.col(a), F.col("snapshot"))
    return g.crossJoin(F.broadcast(snap)).select("customer_id", days("last").alias("recency"), "frequency", F.col("rev").cast("double").alias("monetary"), days("first").alias("tenure"), "n_products", ratio(F.col("rev"), F.col("frequency")).alias("avg_order_value"))


def log_zscore(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(log1p(x) - mean) / sample standard deviation; statistics come from one row, not from a global window."""
    logs = df.select(key, *(F.log1p(F.col(c).cast("double")).alias(c) for c in cols))
    stats = logs.agg(*(x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_samp(c).alias(f"{c}_s"))))
    return logs.crossJoin(F.broadcast(stats)).select(key, *(r6(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s"))).alias(f"{c}_z") for c in cols))


def domain_features(c: DataFrame) -> DataFrame:
    """Five derived churn columns."""
    return c.withColumns({
        "zero_balance": (F.col("balance") == 0).cast("int"),
        "balance_salary_ratio": F.col("balance") / (F.col("salary") + 1),
        "german_balance": F.when(F.col("geography") == "EUROPE", F.col("balance") / 1e5).otherwise(0.0),
        "products_cat": F.col("num_products").cast("string"),
        "inactive_senior": ((F.col("is_active") == 0) & (F.col("age") >= 45)).cast("int"),
    })


def one_hot(df: DataFrame, col: str, levels: list, drop_first: bool = True) -> DataFrame:
    """0/1 columns of the sorted levels, the first one dropped; unknown and null levels are all zero."""
    levels = sorted(levels)[1 if drop_first else 0 :]
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in levels})


def levels_of(df: DataFrame, col: str) -> list:
    """The distinct non-null levels, sorted: the fitted state of an encoder."""
    return sorted(r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().collect())


def category_codes(df: DataFrame, col: str, name: str) -> DataFrame:
    """Codes of the sorted levels from 0; null is -1. Only distinct levels are ordered, in ranges."""
    levels = numbered(df.where(F.col(col).isNotNull()).select(col).distinct(), col, name)
    return df.join(levels, col, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def standardise(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column is divided by 1."""
    stats = df.agg(*(x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"{c}_m"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}_s"))))
    return df.crossJoin(F.broadcast(stats)).select(key, *(r6((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s"))).alias(c) for c in cols))


def median_filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles, nulls replaced by the exact median."""
    med = medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c]).cast("double")) for c in cols})


def median_impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become the exact median; a 0/1 column tells which were."""
    med = medians(df, cols)
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols} | {c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in cols})


def stratified_rank(df: DataFrame, key: str, target: str) -> DataFrame:
    """Position of each row within its class by a keyed hash, with the class size.

    Ranks are counted within hash cells first and offset by the cells before, so
    that no task sorts a whole class.
    """
    h = df.withColumn("mg_h", keyed_hash(F.col(key)))
    cells = h.groupBy(target, "mg_h").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(target).orderBy("mg_h").rowsBetween(W.unboundedPreceding, -1))
    offs = cells.select(F.col(target).alias("mg_t"), F.col("mg_h").alias("mg_c"), F.coalesce(before, F.lit(0)).alias("off"), F.sum("n").over(W.partitionBy(target)).alias("class_n"))
    inner = F.row_number().over(W.partitionBy(target, "mg_h").orderBy(key))
    return h.withColumn("mg_r", inner).join(F.broadcast(offs), (F.col(target) == F.col("mg_t")) & (F.col("mg_h") == F.col("mg_c"))).withColumn("pos", F.col("off") + F.col("mg_r")).drop("mg_r", "mg_t", "mg_c", "off", "mg_h")


def stratified_split(df: DataFrame, key: str, target: str, test: float = 0.2) -> DataFrame:
    """is_test by class: the first floor(test * n) rows in hash order."""
    return stratified_rank(df, key, target).withColumn("is_test", (F.col("pos") <= F.floor(F.lit(test) * F.col("class_n"))).cast("int")).drop("pos", "class_n")


def stratified_folds(df: DataFrame, key: str, target: str, folds: int = 5) -> DataFrame:
    return stratified_rank(df, key, target).withColumn("fold", ((F.col("pos") - 1) % folds).cast("int")).drop("pos", "class_n")
