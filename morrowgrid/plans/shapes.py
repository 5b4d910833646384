"""Sources and sinks, reshaping, picking and formatting queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import scaled_round
from ..operators import metrics as mt
from ..operators import profile as pr
from ..operators import quality as ql
from ..operators import shapes as sh
from ..session import shared_folder
from ..sources import inference as inf
from ..sources import tables as tb
from .registry import query, with_views
from .scores import _CUM
from .views import CHURN, LOANS, SCORED, churn, loans, scored

_CSV = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType()), T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("note", T.StringType())])


@query("csv_source", "SELECT o_orderkey, o_totalprice, o_orderpriority, date_trunc('second', o_orderdate) AS o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'Café ' || o_orderpriority END AS note FROM orders")
def csv_source(spark, sf):
    """Orders written as Latin-1 CSV, fetched into a cache and scanned with declared types and two timestamp formats."""
    base = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    o = spark.read.parquet(f"{sf}/orders.parquet")
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Café "), F.col("o_orderpriority")))
    tb.write_csv(o.select("o_orderkey", "o_totalprice", "o_orderpriority", stamp.alias("o_orderdate"), note.alias("note")), f"{base}/source", "ISO-8859-1")
    cached = tb.fetch(spark, f"{base}/cached", [f"{base}/missing", f"{base}/source"])
    return tb.read_csv(spark, cached, _CSV, "ISO-8859-1", {"o_orderdate": ["M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss"]})


@query("csv_inferred", """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END AS even, CAST(o_orderkey % 100 AS DECIMAL(4,2)) + CAST(0.25 AS DECIMAL(4,2)) AS cents,
  CASE WHEN o_orderkey % 5 <> 0 THEN date_trunc('second', o_orderdate) END AS placed, CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS mixed FROM orders""")
def csv_inferred(spark, sf):
    """Orders written as CSV without types, with gaps, two timestamp forms and a column of mixed values; the types are inferred from all rows."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    stamp = F.when(k % 5 == 0, "NA").when(k % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy H:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    cols = {"o_orderkey": k, "o_totalprice": F.format_string("%.12e", "o_totalprice"), "even": F.when(k % 7 != 0, F.when(k % 2 == 0, "true").otherwise("False")).otherwise(""), "cents": F.concat((k % 100).cast("string"), F.lit(".25")), "placed": stamp, "mixed": F.when(k % 9 == 0, "x").otherwise(k.cast("string"))}
    tb.write_csv(spark.read.parquet(f"{sf}/orders.parquet").select(*(v.cast("string").alias(n) for n, v in cols.items())), path)
    return inf.read_csv_inferred(spark, path)


_STATS = ("n", "mean", "min_value", "max_value")
_DESCRIBED = ("de", " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS n, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM churn" for c in ("age", "balance")))


@query("describe_transposed", with_views(" UNION ALL ".join(f"SELECT '{s}' AS statistic, max({s}) FILTER (column_name = 'age') AS age, max({s}) FILTER (column_name = 'balance') AS balance FROM de" for s in _STATS), CHURN, _DESCRIBED))
def describe_transposed(spark, sf):
    """A row per statistic instead of a row per column."""
    return sh.transpose(ql.describe(churn(spark, sf), ["age", "balance"]).select("column_name", *(F.col(s).cast("double").alias(s) for s in _STATS)), "column_name", ["age", "balance"], "statistic")


_NUMERIC = ("loan_id", "age", "income", "emp_length", "amount", "int_rate", "pct_income", "cred_hist", "status", "pd12")


@query("numeric_medians", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median FROM loans" for c in _NUMERIC), LOANS))
def numeric_medians(spark, sf):
    """Medians of whichever columns are numbers."""
    return sh.column_medians(sh.numeric_only(loans(spark, sf)))


@query("picked_rows", with_views("SELECT p.pos, p.label AS grade, count(l.loan_id) AS n FROM (VALUES (1, 'C'), (2, 'A'), (3, 'Z')) p(pos, label) LEFT JOIN loans l ON l.grade = p.label GROUP BY p.pos, p.label", LOANS))
def picked_rows(spark, sf):
    """Rows by label in the order of a list; a label that isn't there counts 0."""
    g = loans(spark, sf).groupBy("grade").agg(F.count("*").alias("n"))
    return sh.pick(g, "grade", ["C", "A", "Z"]).select("pos", "grade", F.coalesce("n", F.lit(0)).alias("n"))


@query("parameter_grid", "SELECT DISTINCT greatest(2, k + d) AS k, round(r + e, 1) AS ratio FROM (VALUES (3, 0.4::DOUBLE), (5, 0.6)) b(k, r), (VALUES (-2), (0), (2)) x(d), (VALUES (-0.2::DOUBLE), (0.0), (0.2)) y(e)")
def parameter_grid(spark, sf):
    """Neighbours of two settings, without repeats."""
    return spark.createDataFrame(sh.grid({}, [(max(2, k + d), round(r + e, 1)) for k, r in ((3, 0.4), (5, 0.6)) for d in (-2, 0, 2) for e in (-0.2, 0.0, 0.2)]), "k int, ratio double")


@query("sorted_arrays", "SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate))) AS years FROM orders GROUP BY o_custkey")
def sorted_arrays(spark, sf):
    """The years in which each customer ordered, in order (distinct years, so an array is short)."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", F.year("o_orderdate").cast("long").alias("y")).distinct()
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("y")).alias("years"))


@query("text_parts", "SELECT c_custkey, regexp_extract(c_name, '[^#]*$') AS last_part, split_part(c_name, '#', 1) AS first_part FROM customer")
def text_parts(spark, sf):
    c = F.split("c_name", "#")
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.element_at(c, -1).alias("last_part"), c[0].alias("first_part"))


@query("date_part", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_part(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("format_money", with_views("SELECT customer_id, '€' || format('{:,}', CAST(round(balance) AS BIGINT)) AS money, printf('%+.1f pp', round((balance - salary) / 1000, 1)) AS gap, printf('%.1f%%', round(100 * balance / salary, 1)) AS share FROM churn", CHURN))
def format_money(spark, sf):
    """Currency with thousands, a signed difference, a percentage."""
    return churn(spark, sf).select("customer_id", F.concat(F.lit("€"), F.format_number(F.round("balance").cast("long"), 0)).alias("money"), F.format_string("%+.1f pp", scaled_round((F.col("balance") - F.col("salary")) / 1000, 1)).alias("gap"), F.format_string("%.1f%%", scaled_round(100 * F.col("balance") / F.col("salary"), 1)).alias("share"))


@query("text_table", with_views("SELECT 0 AS no, 'geography' || chr(9) || 'target_rate' || chr(9) || 'n' AS line UNION ALL SELECT CAST(row_number() OVER (ORDER BY geography) AS INTEGER), geography || chr(9) || printf('%.4f', sum(exited) / count(*)) || chr(9) || count(*) FROM churn GROUP BY geography", CHURN))
def text_table(spark, sf):
    """A report table as text."""
    return tb.as_lines(pr.group_rate(churn(spark, sf), "geography", "exited"), "geography")


@query("plot_roc", with_views("SELECT 'line' AS kind, s AS series, CAST(fp AS DOUBLE) / tot_neg AS x, CASE s WHEN 'tpr' THEN CAST(tp AS DOUBLE) / tot_pos ELSE CAST(fp AS DOUBLE) / tot_neg END AS y FROM cum, (VALUES ('tpr'), ('chance')) t(s)", SCORED, _CUM))
def plot_roc(spark, sf):
    """The points of a ROC plot with its diagonal."""
    return tb.plot_data(mt.roc_points(scored(spark, sf)).select("fpr", "tpr", F.col("fpr").alias("chance")), "fpr", ["tpr", "chance"])
