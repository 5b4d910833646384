"""Quality, profile and feature queries over the base relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import profile as pr
from ..operators import quality as ql
from .registry import query, with_views
from .views import CHURN, CLEAN, LOANS, TXN, churn, clean_txn, loans, txn

_LONG_NULLS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing FROM loans" for c in ("emp_length", "int_rate", "amount", "grade"))


@query("shape_check", with_views("SELECT count(*) AS n_rows, 12 AS n_cols FROM churn", CHURN))
def shape_check(spark, sf):
    return ql.shape(churn(spark, sf))


@query("null_audit", with_views(_LONG_NULLS, LOANS))
def null_audit(spark, sf):
    return ql.null_counts(loans(spark, sf), ["emp_length", "int_rate", "amount", "grade"])


@query("dup_audit", "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_duplicates FROM lineitem")
def dup_audit(spark, sf):
    return ql.duplicate_rows(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber"))


@query("domain_check", with_views("SELECT exited AS value, count(*) AS n, CAST(exited IN (0, 1) AS INTEGER) AS allowed FROM churn GROUP BY exited", CHURN))
def domain_check(spark, sf):
    return ql.domain(churn(spark, sf), "exited", [0, 1])


@query("key_uniqueness", with_views("SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_keys, count(*) FILTER (customer_id IS NULL) AS n_null, CAST(count(*) = count(DISTINCT customer_id) AS INTEGER) AS is_unique FROM churn", CHURN))
def key_uniqueness(spark, sf):
    return ql.key_unique(churn(spark, sf), "customer_id")


@query("txn_audit", with_views("""SELECT count(*) AS n_lines, count(*) FILTER (customer_id IS NULL) AS n_no_customer, count(*) FILTER (customer_id IS NULL) / count(*) AS share_no_customer,
  count(*) FILTER (invoice_no LIKE 'C%') AS n_cancelled, count(*) FILTER (quantity <= 0) AS n_bad_quantity, count(*) FILTER (unit_price <= 0) AS n_bad_price,
  (SELECT count(*) FROM clean) AS n_clean, (SELECT count(DISTINCT customer_id) FROM clean) AS n_customers, (SELECT CAST(sum(revenue) AS DOUBLE) FROM clean) AS revenue FROM txn""", TXN, CLEAN))
def txn_audit(spark, sf):
    return ql.transaction_audit(txn(spark, sf))


@query("impossible_values", with_views("""SELECT 'age_over_100' AS rule, count(*) FILTER (age > 100) AS n, CAST(max(age) AS DOUBLE) AS max_value FROM loans
  UNION ALL SELECT 'employed_over_60', count(*) FILTER (emp_length > 60), max(emp_length) FROM loans""", LOANS))
def impossible_values(spark, sf):
    return ql.impossible(loans(spark, sf), [("age_over_100", F.col("age") > 100, "age"), ("employed_over_60", F.col("emp_length") > 60, "emp_length")])


@query("plausible_loans", with_views("SELECT count(*) AS n FROM loans WHERE age <= 100 AND coalesce(emp_length, 0) <= 60", LOANS))
def plausible_loans(spark, sf):
    return loans(spark, sf).where((F.col("age") <= 100) & (F.coalesce("emp_length", F.lit(0.0)) <= 60)).agg(F.count("*").alias("n"))


@query("missingness_signal", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} IS NULL AS INTEGER) AS missing, count(*) AS n, CAST(sum(status) AS DOUBLE) / count(*) AS target_rate FROM loans GROUP BY {c} IS NULL" for c in ("emp_length", "int_rate")), LOANS))
def missingness_signal(spark, sf):
    return ql.missingness_signal(loans(spark, sf), ["emp_length", "int_rate"], "status")


_DESC = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min_value, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max_value FROM churn" for c in ("age", "credit_score", "tenure"))


@query("describe_numeric", with_views(_DESC, CHURN))
def describe_numeric(spark, sf):
    return ql.describe(churn(spark, sf), ["age", "credit_score", "tenure"])


@query("base_rate", with_views("SELECT CAST(sum(exited) AS DOUBLE) / count(*) AS target_rate FROM churn", CHURN))
def base_rate(spark, sf):
    return churn(spark, sf).agg(pr.rate("exited").alias("target_rate"))


@query("group_rate", with_views("SELECT geography, CAST(sum(exited) AS DOUBLE) / count(*) AS target_rate, count(*) AS n FROM churn GROUP BY geography", CHURN))
def group_rate(spark, sf):
    return pr.group_rate(churn(spark, sf), "geography", "exited")


@query("zero_share_by_group", with_views("SELECT geography, CAST(count(*) FILTER (balance = 0) AS DOUBLE) / count(*) AS share, count(*) AS n FROM churn GROUP BY geography", CHURN))
def zero_share_by_group(spark, sf):
    return pr.group_share(churn(spark, sf), "geography", F.col("balance") == 0)


_RATES = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, CAST(sum(exited) AS DOUBLE) / count(*) AS target_rate, count(*) AS n FROM churn GROUP BY {c}" for c in ("geography", "gender", "is_active", "has_card"))


@query("segment_rates_long", with_views(_RATES, CHURN))
def segment_rates_long(spark, sf):
    return pr.rates_long(churn(spark, sf), ["geography", "gender", "is_active", "has_card"], "exited")


AGE_EDGES = [18, 35, 45, 55, 92]
_AGE = "CASE WHEN age > 18 AND age <= 35 THEN 0 WHEN age > 35 AND age <= 45 THEN 1 WHEN age > 45 AND age <= 55 THEN 2 WHEN age > 55 AND age <= 92 THEN 3 END"


@query("binned_rate_fixed", with_views(f"SELECT bin, CAST(sum(exited) AS DOUBLE) / count(*) AS target_rate, count(*) AS n FROM (SELECT {_AGE} AS bin, exited FROM churn) WHERE bin IS NOT NULL GROUP BY bin", CHURN))
def binned_rate_fixed(spark, sf):
    return pr.binned_rate(churn(spark, sf), "age", AGE_EDGES, "exited")


_EDGES = "(SELECT list_distinct(q) AS e FROM (SELECT quantile_cont({c}, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]) AS q FROM {t}))"


def decile_bin(c: str, t: str) -> str:
    return f"SELECT *, CASE WHEN {c} IS NULL THEN NULL ELSE greatest(len(list_filter(e, lambda x: x < {c})) - 1, 0) END AS bin FROM {t}, " + _EDGES.format(c=c, t=t)


@query("decile_rate", with_views("SELECT CAST(bin AS INTEGER) AS bin, CAST(sum(status) AS DOUBLE) / count(*) AS target_rate, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin", LOANS, ("b", decile_bin("amount", "loans"))))
def decile_rate(spark, sf):
    return pr.quantile_rate(loans(spark, sf), "amount", 10, "status")


_PIVOT = ", ".join(f"CAST(sum(exited) FILTER (num_products = {v}) AS DOUBLE) / count(*) FILTER (num_products = {v}) AS num_products_{v}" for v in (1, 2, 3, 4))


@query("pivot_rate", with_views(f"SELECT geography, {_PIVOT} FROM churn GROUP BY geography", CHURN))
def pivot_rate(spark, sf):
    return pr.pivot_rate(churn(spark, sf), "geography", "num_products", [1, 2, 3, 4], "exited")


@query("pivot_binned_rate", with_views(f"SELECT bin, {_PIVOT} FROM (SELECT {_AGE} AS bin, * FROM churn) WHERE bin IS NOT NULL GROUP BY bin", CHURN))
def pivot_binned_rate(spark, sf):
    return pr.pivot_rate(churn(spark, sf).withColumn("bin", pr.cut_bins(F.col("age"), AGE_EDGES)), "bin", "num_products", [1, 2, 3, 4], "exited")


@query("crosstab", with_views("SELECT x.grade, y.home, count(l.loan_id) AS n FROM (SELECT DISTINCT grade FROM loans) x CROSS JOIN (SELECT DISTINCT home FROM loans) y LEFT JOIN loans l ON l.grade = x.grade AND l.home = y.home GROUP BY ALL", LOANS))
def crosstab(spark, sf):
    return pr.crosstab(loans(spark, sf), "grade", "home")


def _hist(v: str, t: str, bins: int) -> str:
    return f"""SELECT exited, bin, n, round(n / (sum(n) OVER (PARTITION BY exited) * ((hi - lo) / {bins})), 6) AS density FROM (
      SELECT exited, CAST(least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin, lo, hi, count(*) AS n
      FROM (SELECT CAST({v} AS DOUBLE) AS v, exited FROM {t}), (SELECT min(CAST({v} AS DOUBLE)) AS lo, max(CAST({v} AS DOUBLE)) AS hi FROM {t}) GROUP BY ALL)"""


@query("hist_density_by_class", with_views(_hist("credit_score", "churn", 30), CHURN))
def hist_density_by_class(spark, sf):
    return pr.density_histogram(churn(spark, sf), "credit_score", 30, "exited")


@query("hist_clip_q99", with_views(_hist("age", "c", 40), CHURN, ("c", "SELECT exited, least(CAST(age AS DOUBLE), (SELECT quantile_cont(age, 0.99) FROM churn)) AS age FROM churn")))
def hist_clip_q99(spark, sf):
    return pr.clipped_histogram(churn(spark, sf), "age", 40, "exited")


@query("five_number_summary", with_views("""SELECT geography, min(v) FILTER (inside) AS low, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, max(v) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS n_outliers
  FROM (SELECT geography, CAST(age AS DOUBLE) AS v, q1, med, q3, age >= q1 - 1.5 * (q3 - q1) AND age <= q3 + 1.5 * (q3 - q1) AS inside FROM churn JOIN
    (SELECT geography, quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.5) AS med, quantile_cont(age, 0.75) AS q3 FROM churn GROUP BY geography) USING (geography)) GROUP BY geography, q1, med, q3""", CHURN))
def five_number_summary(spark, sf):
    return pr.five_numbers(churn(spark, sf), "age", "geography")


_NUM = ["age", "credit_score", "num_products", "balance"]
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i:]]


@query("pearson_matrix", with_views(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM churn" for a, b in _PAIRS), CHURN))
def pearson_matrix(spark, sf):
    return pr.pearson(churn(spark, sf), _NUM)


_RANKED = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("age", "credit_score", "tenure")) + " FROM churn"


@query("spearman_matrix", with_views(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM k" for a, b in [("age", "age"), ("age", "credit_score"), ("age", "tenure"), ("credit_score", "credit_score"), ("credit_score", "tenure"), ("tenure", "tenure")]), CHURN, ("k", _RANKED)))
def spearman_matrix(spark, sf):
    return pr.spearman(churn(spark, sf), ["age", "credit_score", "tenure"])


@query("skew_raw_log", with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(skewness({c}), 6) AS skew_raw, round(skewness(ln(1 + {c})), 6) AS skew_log FROM r" for c in ("frequency", "monetary")), TXN, CLEAN, ("r", "SELECT customer_id, CAST(count(DISTINCT invoice_no) AS DOUBLE) AS frequency, CAST(sum(revenue) AS DOUBLE) AS monetary FROM clean GROUP BY customer_id")))
def skew_raw_log(spark, sf):
    return pr.skewness(ft.rfm(clean_txn(spark, sf)), ["frequency", "monetary"])


@query("topk_rows", with_views("SELECT loan_id, amount, grade FROM loans ORDER BY amount DESC, loan_id LIMIT 5", LOANS))
def topk_rows(spark, sf):
    return pr.top_k(loans(spark, sf).select("loan_id", "amount", "grade"), "amount", 5, "loan_id")


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe_rows(spark, sf):
    return pr.dedupe(spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber"))


RFM_SQL = """SELECT customer_id, date_sub('day', max(invoice_date), s) AS recency, count(DISTINCT invoice_no) AS frequency, CAST(sum(revenue) AS DOUBLE) AS monetary,
  date_sub('day', min(invoice_date), s) AS tenure, count(DISTINCT stock_code) AS n_products, CAST(sum(revenue) AS DOUBLE) / count(DISTINCT invoice_no) AS avg_order_value
  FROM clean, (SELECT max(invoice_date) + INTERVAL 1 DAY AS s FROM clean) GROUP BY customer_id, s"""


@query("rfm_base", with_views(RFM_SQL, TXN, CLEAN))
def rfm_base(spark, sf):
    return ft.rfm(clean_txn(spark, sf))


@query("rfm_log_zscore", with_views("SELECT customer_id, " + ", ".join(f"round((ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM rfm)) / (SELECT stddev_samp(ln(1 + {c})) FROM rfm), 6) AS {c}_z" for c in ("recency", "frequency", "monetary")) + " FROM rfm", TXN, CLEAN, ("rfm", RFM_SQL)))
def rfm_log_zscore(spark, sf):
    return ft.log_zscore(ft.rfm(clean_txn(spark, sf)), "customer_id", ["recency", "frequency", "monetary"])


@query("domain_features", with_views("""SELECT customer_id, CAST(balance = 0 AS INTEGER) AS zero_balance, balance / (salary + 1) AS balance_salary_ratio, CASE WHEN geography = 'EUROPE' THEN balance / 1e5 ELSE 0.0 END AS german_balance,
  CAST(num_products AS VARCHAR) AS products_cat, CAST(is_active = 0 AND age >= 45 AS INTEGER) AS inactive_senior FROM churn""", CHURN))
def domain_features(spark, sf):
    return ft.domain_features(churn(spark, sf)).select("customer_id", "zero_balance", "balance_salary_ratio", "german_balance", "products_cat", "inactive_senior")


@query("onehot_dropfirst", with_views("SELECT customer_id, CAST(gender = 'Male' AS INTEGER) AS \"gender_Male\" FROM churn", CHURN))
def onehot_dropfirst(spark, sf):
    c = churn(spark, sf)
    return ft.one_hot(c, "gender", ft.levels_of(c, "gender")).select("customer_id", "gender_Male")


@query("category_codes", with_views("SELECT loan_id, grade, dense_rank() OVER (ORDER BY grade) - 1 AS code FROM loans", LOANS))
def category_codes(spark, sf):
    return ft.category_codes(loans(spark, sf).select("loan_id", "grade"), "grade", "code").select("loan_id", "grade", F.col("code").cast("long").alias("code"))


@query("scale_pop", with_views("SELECT customer_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM churn)) / (SELECT stddev_pop({c}) FROM churn), 6) AS {c}" for c in ("age", "credit_score")) + " FROM churn", CHURN))
def scale_pop(spark, sf):
    return ft.standardise(churn(spark, sf), "customer_id", ["age", "credit_score"])


@query("median_impute_flag", with_views("SELECT loan_id, coalesce(emp_length, (SELECT quantile_cont(emp_length, 0.5) FROM loans)) AS emp_length, CAST(emp_length IS NULL AS INTEGER) AS emp_length_missing FROM loans", LOANS))
def median_impute_flag(spark, sf):
    return ft.median_impute(loans(spark, sf), ["emp_length"]).select("loan_id", "emp_length", "emp_length_missing")


_ORDERED = "SELECT loan_id, status, row_number() OVER (PARTITION BY status ORDER BY (loan_id * 2654435761) % 1000, loan_id) AS pos, count(*) OVER (PARTITION BY status) AS n FROM loans"


@query("stratified_split", with_views("SELECT loan_id, status, CAST(pos <= floor(0.2 * n) AS INTEGER) AS is_test FROM o", LOANS, ("o", _ORDERED)))
def stratified_split(spark, sf):
    return ft.stratified_split(loans(spark, sf).select("loan_id", "status"), "loan_id", "status")


@query("stratified_folds", with_views("SELECT loan_id, status, CAST((pos - 1) % 5 AS INTEGER) AS fold FROM o", LOANS, ("o", _ORDERED)))
def stratified_folds(spark, sf):
    return ft.stratified_folds(loans(spark, sf).select("loan_id", "status"), "loan_id", "status")


@query("preview", with_views("SELECT * FROM (SELECT customer_id, geography, age FROM churn ORDER BY customer_id LIMIT 5)", CHURN))
def preview(spark, sf):
    return churn(spark, sf).select("customer_id", "geography", "age").orderBy("customer_id").limit(5)


@query("format_rates", with_views("SELECT geography, printf('%.1f%%', 100.0 * sum(exited) / count(*)) AS shown FROM churn GROUP BY geography", CHURN))
def format_rates(spark, sf):
    return pr.group_rate(churn(spark, sf), "geography", "exited").select("geography", F.format_string("%.1f%%", F.col("target_rate") * 100).alias("shown"))
