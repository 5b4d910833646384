"""Base relations over the star schema: transactions, churn customers, loans, scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CENTS, case_when, keyed_hash, ratio
from ..sources.tables import table


def txn(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines: returned lines are cancellations, a quarter of the orders have no customer."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.concat(F.when(F.col("l_returnflag") == "R", "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("invoice_no"),
        F.col("l_partkey").alias("stock_code"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("o_orderdate").alias("invoice_date"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("customer_id"),
    )


TXN = ("txn", """SELECT concat(CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END, CAST(o_orderkey AS VARCHAR)) AS invoice_no, l_partkey AS stock_code,
  CAST(l_quantity AS INTEGER) AS quantity, p_retailprice AS unit_price, o_orderdate AS invoice_date, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS customer_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")


def clean_txn(spark: SparkSession, sf: str) -> DataFrame:
    """Sales only: known customer, no cancellation, positive quantity and price; revenue in exact cents."""
    t = txn(spark, sf)
    kept = t.where(~F.col("invoice_no").startswith("C") & F.col("customer_id").isNotNull() & (F.col("quantity") > 0) & (F.col("unit_price") > 0))
    return kept.withColumn("revenue", (F.col("quantity").cast(CENTS) * F.col("unit_price").cast(CENTS)).cast(CENTS))


CLEAN = ("clean", """SELECT *, CAST(CAST(quantity AS DECIMAL(18,2)) * CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS revenue FROM txn
  WHERE invoice_no NOT LIKE 'C%' AND customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0""")


def churn(spark: SparkSession, sf: str) -> DataFrame:
    """Bank customers; exited: no order in the last year of the data."""
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderdate").alias("end"))
    per = o.crossJoin(F.broadcast(last)).groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.max(F.when(F.col("o_orderdate") >= F.expr("end - interval 365 day"), 1).otherwise(0)).alias("recent"),
        F.max(F.when((F.col("o_orderdate") < F.expr("end - interval 365 day")) & (F.col("o_orderdate") >= F.expr("end - interval 730 day")), 1).otherwise(0)).alias("earlier"),
    )
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("c_custkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).join(per, k == F.col("o_custkey"), "left").select(
        k.alias("customer_id"),
        (350 + k * 7919 % 500).cast("int").alias("credit_score"),
        F.col("r_name").alias("geography"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (18 + k * 31 % 75).cast("int").alias("age"),
        (k % 11).cast("int").alias("tenure"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("balance"),
        (1 + F.coalesce("n_orders", F.lit(0)) % 4).cast("int").alias("num_products"),
        (k % 3 != 0).cast("int").alias("has_card"),
        F.coalesce("earlier", F.lit(0)).cast("int").alias("is_active"),
        (10000 + k * 104729 % 190000).cast("double").alias("salary"),
        (1 - F.coalesce("recent", F.lit(0))).cast("int").alias("exited"),
    )


CHURN = ("churn", """SELECT c_custkey AS customer_id, CAST(350 + c_custkey * 7919 % 500 AS INTEGER) AS credit_score, r_name AS geography,
  CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CAST(18 + c_custkey * 31 % 75 AS INTEGER) AS age, CAST(c_custkey % 11 AS INTEGER) AS tenure,
  greatest(c_acctbal, 0.0) AS balance, CAST(1 + coalesce(n_orders, 0) % 4 AS INTEGER) AS num_products, CAST(c_custkey % 3 <> 0 AS INTEGER) AS has_card,
  CAST(coalesce(earlier, 0) AS INTEGER) AS is_active, CAST(10000 + c_custkey * 104729 % 190000 AS DOUBLE) AS salary, CAST(1 - coalesce(recent, 0) AS INTEGER) AS exited
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, max(CASE WHEN o_orderdate >= e - INTERVAL 365 DAY THEN 1 ELSE 0 END) AS recent,
      max(CASE WHEN o_orderdate < e - INTERVAL 365 DAY AND o_orderdate >= e - INTERVAL 730 DAY THEN 1 ELSE 0 END) AS earlier
    FROM orders, (SELECT max(o_orderdate) AS e FROM orders) GROUP BY o_custkey) ON c_custkey = o_custkey""")


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Loans with missing values, outliers and a deterministic 12-month default probability."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ratio(F.sum(F.col("l_discount").cast(CENTS)), F.count("*")).alias("disc"))
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("o_orderkey")
    income = F.lit(20000) + F.col("o_custkey") * 7919 % 100000
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(li, k == li.l_orderkey, "left").select(
        k.alias("loan_id"),
        (20 + F.col("o_custkey") * 13 % 60 + F.when(k % 997 == 0, 80).otherwise(0)).cast("int").alias("age"),
        income.cast("long").alias("income"),
        F.when(k % 36 != 0, (k * 17 % 40 + F.when(k % 1499 == 0, 100).otherwise(0)).cast("double")).alias("emp_length"),
        case_when([(F.col("n_regionkey") % 4 == 0, "RENT"), (F.col("n_regionkey") % 4 == 1, "MORTGAGE"), (F.col("n_regionkey") % 4 == 2, "OWN")], "OTHER").alias("home"),
        F.col("c_mktsegment").alias("intent"),
        F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE").alias("grade"),
        F.col("o_totalprice").alias("amount"),
        F.when(k % 10 != 0, 5 + 100 * F.col("disc")).alias("int_rate"),
        ratio(F.col("o_totalprice"), income * 10).alias("pct_income"),
        F.when(k % 5 == 0, "Y").otherwise("N").alias("default_on_file"),
        (2 + k % 28).cast("int").alias("cred_hist"),
        (F.col("o_orderstatus") == "F").cast("int").alias("status"),
        (keyed_hash(k) / F.lit(1000.0)).alias("pd12"),
    )


LOANS = ("loans", """SELECT o_orderkey AS loan_id, CAST(20 + o_custkey * 13 % 60 + CASE WHEN o_orderkey % 997 = 0 THEN 80 ELSE 0 END AS INTEGER) AS age,
  CAST(20000 + o_custkey * 7919 % 100000 AS BIGINT) AS income, CASE WHEN o_orderkey % 36 <> 0 THEN CAST(o_orderkey * 17 % 40 + CASE WHEN o_orderkey % 1499 = 0 THEN 100 ELSE 0 END AS DOUBLE) END AS emp_length,
  CASE WHEN n_regionkey % 4 = 0 THEN 'RENT' WHEN n_regionkey % 4 = 1 THEN 'MORTGAGE' WHEN n_regionkey % 4 = 2 THEN 'OWN' ELSE 'OTHER' END AS home, c_mktsegment AS intent,
  translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') AS grade, o_totalprice AS amount, CASE WHEN o_orderkey % 10 <> 0 THEN 5 + 100 * disc END AS int_rate,
  o_totalprice / ((20000 + o_custkey * 7919 % 100000) * 10) AS pct_income, CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS default_on_file, CAST(2 + o_orderkey % 28 AS INTEGER) AS cred_hist,
  CAST(o_orderstatus = 'F' AS INTEGER) AS status, ((o_orderkey * 2654435761) % 1000) / 1000.0::DOUBLE AS pd12
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS disc FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(id, y, p): loan outcomes with a deterministic score that has ties."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return o.select(k.alias("id"), y.alias("y"), ((keyed_hash(k, 700) + 300 * y) / F.lit(1000.0)).alias("p"))


SCORED = ("scored", """SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
  ((o_orderkey * 2654435761) % 700 + 300 * CAST(o_orderstatus = 'F' AS INTEGER)) / 1000.0::DOUBLE AS p FROM orders""")


def causal(spark: SparkSession, sf: str) -> DataFrame:
    """(id, t, y, e and covariates): activity as treatment, churn as outcome, a given propensity."""
    c = churn(spark, sf)
    return c.select(F.col("customer_id").alias("id"), F.col("is_active").alias("t"), F.col("exited").alias("y"), ((100 + keyed_hash(F.col("customer_id"), 800)) / F.lit(1000.0)).alias("e"), F.col("age").cast("double").alias("age"), F.col("credit_score").cast("double").alias("credit_score"), "balance", F.col("tenure").cast("double").alias("tenure"), "geography", "gender")


CAUSAL = ("causal", """SELECT customer_id AS id, is_active AS t, exited AS y, (100 + (customer_id * 2654435761) % 800) / 1000.0::DOUBLE AS e,
  CAST(age AS DOUBLE) AS age, CAST(credit_score AS DOUBLE) AS credit_score, balance, CAST(tenure AS DOUBLE) AS tenure, geography, gender FROM churn""")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")
