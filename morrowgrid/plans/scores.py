"""Association, evaluation, decision, credit and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal as cs
from ..operators import credit as cr
from ..operators import decision as dc
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import stats as st
from ..session import cut_lineage
from .audits import RFM_SQL, decile_bin
from .registry import query, with_views
from .views import CAUSAL, CHURN, CLEAN, LOANS, SCORED, TXN, causal, churn, clean_txn, loans, scored

# ---- association -----------------------------------------------------------

_CELLS = ("cells", "SELECT x.grade, y.status, count(l.loan_id) AS n FROM (SELECT DISTINCT grade FROM loans) x CROSS JOIN (SELECT DISTINCT status FROM loans) y LEFT JOIN loans l ON l.grade = x.grade AND l.status = y.status GROUP BY ALL")
_EXPECTED = ("ex", "SELECT n, sum(n) OVER (PARTITION BY grade) * CAST(sum(n) OVER (PARTITION BY status) AS DOUBLE) / sum(n) OVER () AS e, (SELECT count(DISTINCT grade) FROM loans) AS r, (SELECT count(DISTINCT status) FROM loans) AS k, sum(n) OVER () AS t FROM cells")
_CHI = ("chi", "SELECT sum(power(abs(n - e) - CASE WHEN (r - 1) * (k - 1) = 1 THEN least(0.5, abs(n - e)) ELSE 0 END, 2) / e) AS chi2, r, k, CAST(t AS DOUBLE) AS t FROM ex GROUP BY r, k, t")


@query("chi2_stat", with_views("SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (k - 1) AS BIGINT) AS dof FROM chi", LOANS, _CELLS, _EXPECTED, _CHI))
def chi2_stat(spark, sf):
    return st.chi2(loans(spark, sf), "grade", "status").select(F.round("chi2", 6).alias("chi2"), F.col("dof").cast("long").alias("dof"))


# an even number of degrees of freedom has a closed form
@query("chi2_pvalue", with_views("SELECT round(chi2, 6) AS chi2, CAST((r - 1) * (k - 1) AS INTEGER) AS dof, round(exp(-chi2 / 2) * list_sum(list_transform(range(0, CAST((r - 1) * (k - 1) / 2 AS BIGINT)), lambda i: power(chi2 / 2, i) / factorial(CAST(i AS INTEGER)))), 6) AS p_value FROM chi", LOANS, _CELLS, _EXPECTED, _CHI))
def chi2_pvalue(spark, sf):
    return st.chi2_test(loans(spark, sf), "grade", "status").select(F.round("chi2", 6).alias("chi2"), "dof", F.round("p_value", 6).alias("p_value"))


@query("cramers_v", with_views("""SELECT round(CASE WHEN low > 0 THEN sqrt(phi / low) ELSE 0 END, 6) AS cramers_v FROM (SELECT greatest(0, chi2 / t - (k - 1) * (r - 1) / (t - 1)) AS phi,
  least(k - (k - 1) * (k - 1) / (t - 1) - 1, r - (r - 1) * (r - 1) / (t - 1) - 1) AS low FROM chi)""", LOANS, _CELLS, _EXPECTED, _CHI))
def cramers_v(spark, sf):
    return st.cramers_v(loans(spark, sf), "grade", "status")


_MW = ("rk", "SELECT status, rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY amount) AS m FROM loans")
_MW2 = ("mw", "SELECT count(*) AS n, CAST(sum(status) AS DOUBLE) AS n1, sum(rk) FILTER (status = 1) AS r1, sum(m * m - 1.0) AS ties FROM rk")


@query("mannwhitney_u", with_views("""SELECT r1 - n1 * (n1 + 1) / 2 AS u, CAST(n1 AS BIGINT) AS n_pos, CAST(n - n1 AS BIGINT) AS n_neg,
  round((greatest(r1 - n1 * (n1 + 1) / 2, n1 * (n - n1) - (r1 - n1 * (n1 + 1) / 2)) - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z,
  round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) - 1, 6) AS rank_biserial FROM mw""", LOANS, _MW, _MW2))
def mannwhitney_u(spark, sf):
    return st.mann_whitney(loans(spark, sf), "amount", "status")


@query("rank_biserial", with_views("SELECT round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) - 1, 6) AS rank_biserial FROM mw", LOANS, _MW, _MW2))
def rank_biserial(spark, sf):
    return st.mann_whitney(loans(spark, sf), "amount", "status").select("rank_biserial")


# the upper incomplete gamma function as one less the series of the lower one
_upper = lambda a, x: f"greatest(0.0::DOUBLE, 1 - CASE WHEN {x} > 0 THEN list_sum(list_transform(range(0, 2000), lambda i: exp(-({x}) + ({a} + i) * ln({x}) - lgamma({a} + i + 1)))) ELSE 0 END)"
_MW_U = "(r1 - n1 * (n1 + 1) / 2)"
_MW_Z = f"((greatest({_MW_U}, n1 * (n - n1) - {_MW_U}) - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))))"


@query("mannwhitney_pvalue", with_views(f"SELECT {_MW_U} AS u, round({_upper('0.5::DOUBLE', f'{_MW_Z} * {_MW_Z} / 2')}, 6) AS p_value FROM mw", LOANS, _MW, _MW2))
def mannwhitney_pvalue(spark, sf):
    return st.mann_whitney_p(loans(spark, sf), "amount", "status").select("u", F.round("p_value", 6).alias("p_value"))


_WOE = ("w", "SELECT level, count(*) FILTER (status = 0) AS good, count(*) FILTER (status = 1) AS bad FROM (SELECT coalesce(CAST(bin AS VARCHAR), 'MISSING') AS level, status FROM b) GROUP BY level")
_WOE2 = ("s", "SELECT *, greatest(CAST(good AS DOUBLE) / sum(good) OVER (), 1e-6) AS gs, greatest(CAST(bad AS DOUBLE) / sum(bad) OVER (), 1e-6) AS bs FROM w")
_RATE_BINS = ("b", decile_bin("int_rate", "loans"))


@query("woe_table", with_views("SELECT level, good, bad, round(ln(gs / bs), 6) AS woe FROM s", LOANS, _RATE_BINS, _WOE, _WOE2))
def woe_table(spark, sf):
    return st.woe(st.binned_levels(loans(spark, sf), "int_rate"), "level", "status").drop("part")


@query("information_value", with_views("SELECT round(sum((gs - bs) * ln(gs / bs)), 6) AS iv FROM s", LOANS, _RATE_BINS, _WOE, _WOE2))
def information_value(spark, sf):
    return st.information_value(st.binned_levels(loans(spark, sf), "int_rate"), "level", "status")


@query("mi_discrete", with_views("""SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER () AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY home) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY status) AS DOUBLE) AS ny
  FROM (SELECT home, status, count(*) AS n FROM loans GROUP BY ALL))""", LOANS))
def mi_discrete(spark, sf):
    return st.mutual_information(loans(spark, sf), "home", "status")


_PSI = "(ln({z} + 6) - 0.5 / ({z} + 6) - (1 / power({z} + 6, 2)) * (1.0::DOUBLE / 12 - (1 / power({z} + 6, 2)) * (1.0::DOUBLE / 120 - (1 / power({z} + 6, 2)) * (1.0::DOUBLE / 252 - (1 / power({z} + 6, 2)) / 240))) - (1 / {z} + 1 / ({z} + 1) + 1 / ({z} + 2) + 1 / ({z} + 3) + 1 / ({z} + 4) + 1 / ({z} + 5)))"
_psi = lambda z: _PSI.format(z=f"CAST({z} AS DOUBLE)")
_KNN = ("knn", """SELECT row_number() OVER () AS id, x, y, count(*) OVER (PARTITION BY y) AS n, list_sort([x - lag(x, 1) OVER w, x - lag(x, 2) OVER w, x - lag(x, 3) OVER w, lead(x, 1) OVER w - x, lead(x, 2) OVER w - x, lead(x, 3) OVER w - x])[least(3, count(*) OVER (PARTITION BY y) - 1)] AS r
  FROM (SELECT CAST(balance AS DOUBLE) AS x, exited AS y FROM churn WHERE balance IS NOT NULL) WINDOW w AS (PARTITION BY y ORDER BY x)""")
_KNN2 = ("inside", "SELECT a.id, a.n, count(*) AS m FROM (SELECT *, r - least(r, 1e-9 * greatest(1.0::DOUBLE, abs(x))) AS reach FROM knn WHERE n > 1) a JOIN knn b ON b.n > 1 AND b.x >= a.x - a.reach AND b.x <= a.x + a.reach GROUP BY a.id, a.n")


@query("mi_knn", with_views(f"SELECT round(greatest(0.0::DOUBLE, {_psi('count(*)')} + avg({_psi('least(3, n - 1)')}) - avg({_psi('n')}) - avg({_psi('m')})), 6) AS mi FROM inside", CHURN, _KNN, _KNN2))
def mi_knn(spark, sf):
    return st.mutual_information_knn(churn(spark, sf), "balance", "exited")


_NUMERIC, _TEXTS = ("amount", "int_rate", "emp_length"), ("grade", "home", "intent")


def _tests_sql(c: str) -> str:
    """u, p and rank-biserial r of a number, and its mutual information with the medians filled in."""
    ranked = f"SELECT status, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {c}) AS m FROM loans WHERE {c} IS NOT NULL"
    sums = f"SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(status) AS DOUBLE) AS n1, CAST(sum(rk) FILTER (status = 1) AS DOUBLE) AS r1, CAST(sum(m * m - 1.0) AS DOUBLE) AS ties FROM ({ranked})"
    gaps = ", ".join(f"{a} - {b}" for j in (1, 2, 3) for a, b in ((f"x", f"lag(x, {j}) OVER w"), (f"lead(x, {j}) OVER w", "x")))
    knn = f"SELECT x, y, count(*) OVER (PARTITION BY y) AS n, list_sort([{gaps}])[least(3, count(*) OVER (PARTITION BY y) - 1)] AS r FROM (SELECT coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM loans)) AS x, status AS y FROM loans) WINDOW w AS (PARTITION BY y ORDER BY x)"
    near = f"SELECT x, y, n, count(*) AS k, r - least(r, 1e-9 * greatest(1.0::DOUBLE, abs(x))) AS reach FROM ({knn}) WHERE n > 1 GROUP BY ALL"
    points = f"SELECT x, count(*) AS c FROM ({knn}) WHERE n > 1 GROUP BY x"
    inside = f"SELECT a.x, a.y, a.n, a.k, sum(b.c) AS m FROM ({near}) a JOIN ({points}) b ON b.x >= a.x - a.reach AND b.x <= a.x + a.reach GROUP BY ALL"
    mean = lambda v: f"sum(k * {v}) / sum(k)"
    mi = f"SELECT greatest(0.0::DOUBLE, {_psi('sum(k)')} + {mean(_psi('least(3, n - 1)'))} - {mean(_psi('n'))} - {mean(_psi('m'))}) AS mi FROM ({inside})"
    return f"SELECT '{c}' AS feature, {_upper('0.5::DOUBLE', f'{_MW_Z} * {_MW_Z} / 2')} AS mwu_p, 2 * {_MW_U} / (n1 * (n - n1)) - 1 AS rank_biserial, mi FROM ({sums}), ({mi})"


_LEVELS = ("lv", " UNION ALL ".join([f"SELECT '{c}' AS feature, coalesce(CAST(bin AS VARCHAR), 'MISSING') AS level, status FROM ({decile_bin(c, 'loans')})" for c in _NUMERIC] + [f"SELECT '{c}', coalesce({c}, 'MISSING'), status FROM loans" for c in _TEXTS]))
_TALLY = ("tally", """SELECT *, sum(good) OVER f AS tg, sum(bad) OVER f AS tb, sum(good + bad) OVER f AS t, CAST(count(*) OVER f AS DOUBLE) AS r FROM (
  SELECT feature, level, CAST(count(*) FILTER (status = 0) AS DOUBLE) AS good, CAST(count(*) FILTER (status = 1) AS DOUBLE) AS bad FROM lv GROUP BY feature, level) WINDOW f AS (PARTITION BY feature)""")
_GAP = lambda a, b: f"power(abs({a} - (good + bad) * {b} / t) - CASE WHEN r = 2 THEN least(0.5, abs({a} - (good + bad) * {b} / t)) ELSE 0 END, 2) / ((good + bad) * {b} / t)"
_TABLES = ("tables", f"""SELECT feature, r, t, sum((greatest(good / tg, 1e-6) - greatest(bad / tb, 1e-6)) * ln(greatest(good / tg, 1e-6) / greatest(bad / tb, 1e-6))) AS iv, sum({_GAP('good', 'tg')} + {_GAP('bad', 'tb')}) AS chi2,
  sum(CASE WHEN good > 0 THEN good / t * ln(good * t / ((good + bad) * tg)) ELSE 0 END + CASE WHEN bad > 0 THEN bad / t * ln(bad * t / ((good + bad) * tb)) ELSE 0 END) AS mi FROM tally GROUP BY feature, r, t""")
_TESTS = ("tests", " UNION ALL ".join(_tests_sql(c) for c in _NUMERIC))


@query("association_table", with_views(f"""SELECT feature, CASE WHEN s.feature IS NULL THEN 'cat' ELSE 'num' END AS type, round({_upper('((r - 1) / 2)', '(chi2 / 2)')}, 4) AS chi2_p,
  round(CASE WHEN least(1 - 1 / (t - 1), r - (r - 1) * (r - 1) / (t - 1) - 1) > 0 THEN sqrt(greatest(0, chi2 / t - (r - 1) / (t - 1)) / least(1 - 1 / (t - 1), r - (r - 1) * (r - 1) / (t - 1) - 1)) ELSE 0 END, 4) AS cramers_v,
  round(mwu_p, 4) AS mwu_p, round(s.rank_biserial, 4) AS rank_biserial, round(iv, 4) AS iv, round(coalesce(s.mi, tables.mi), 4) AS mutual_info FROM tables LEFT JOIN tests s USING (feature)""", LOANS, _LEVELS, _TALLY, _TABLES, _TESTS))
def association_table(spark, sf):
    """Three numbers and three texts against the outcome, all measures from one grouped plan."""
    return st.association_table(loans(spark, sf), list(_NUMERIC), list(_TEXTS), "status")


_CATS = ("geography", "gender", "num_products", "has_card", "is_active")


def _measures(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(sum((gs - bs) * ln(gs / bs)), 6) AS iv, max(v) AS cramers_v, round(sum(mi), 6) AS mutual_info FROM (
      SELECT *, greatest(good / sum(good) OVER (), 1e-6) AS gs, greatest(bad / sum(bad) OVER (), 1e-6) AS bs,
        CASE WHEN good > 0 THEN good / t * ln(good * t / ((good + bad) * tg)) ELSE 0 END + CASE WHEN bad > 0 THEN bad / t * ln(bad * t / ((good + bad) * tb)) ELSE 0 END AS mi,
        round(CASE WHEN least(2 - 1 / (t - 1) - 1, r - (r - 1) * (r - 1) / (t - 1) - 1) > 0 THEN sqrt(greatest(0, chi2 / t - (r - 1) / (t - 1)) / least(2 - 1 / (t - 1) - 1, r - (r - 1) * (r - 1) / (t - 1) - 1)) ELSE 0 END, 6) AS v
      FROM (SELECT *, sum(power(greatest(abs(good - eg) - CASE WHEN r = 2 THEN least(0.5, abs(good - eg)) ELSE 0 END, 0), 2) / eg + power(greatest(abs(bad - eb) - CASE WHEN r = 2 THEN least(0.5, abs(bad - eb)) ELSE 0 END, 0), 2) / eb) OVER () AS chi2 FROM (
        SELECT *, (good + bad) * tg / t AS eg, (good + bad) * tb / t AS eb FROM (
          SELECT *, sum(good) OVER () AS tg, sum(bad) OVER () AS tb, sum(good + bad) OVER () AS t, CAST(count(*) OVER () AS DOUBLE) AS r FROM (
            SELECT {c}, CAST(count(*) FILTER (exited = 0) AS DOUBLE) AS good, CAST(count(*) FILTER (exited = 1) AS DOUBLE) AS bad FROM churn GROUP BY {c})))))"""


_MEASURES = ("ms", " UNION ALL ".join(_measures(c) for c in _CATS))
_NAMES = ("iv", "cramers_v", "mutual_info")
_AVG_RANK = lambda c, o: f"rank() OVER (ORDER BY {c} {o}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_SHOWN = ("sh", "SELECT feature, " + ", ".join(f"CAST(floor({_AVG_RANK(c, 'DESC')}) AS INTEGER) AS {c}" for c in _NAMES) + " FROM ms")
_RERANKED = ("rr", "SELECT " + ", ".join(f"{_AVG_RANK(c, 'ASC')} AS {c}" for c in _NAMES) + " FROM sh")


def _categories(spark, sf):
    m = st.table_measures(st.contingency(churn(spark, sf), [], list(_CATS), "exited"))
    return m.select("feature", *(F.round(c, 6).alias(c) for c in _NAMES))


@query("importance_ranks", with_views("SELECT feature, iv, cramers_v, mutual_info, " + ", ".join(f"s_{c} AS rank_{c}" for c in _NAMES) + " FROM ms JOIN (SELECT feature, " + ", ".join(f"{c} AS s_{c}" for c in _NAMES) + " FROM sh) USING (feature)", CHURN, _MEASURES, _SHOWN))
def importance_ranks(spark, sf):
    """Three importance measures of the categorical columns with their ranks."""
    return st.importance_ranks(_categories(spark, sf), list(_NAMES))


@query("rank_agreement", with_views(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 6) + 0.0::DOUBLE AS r FROM rr" for i, a in enumerate(_NAMES) for b in _NAMES[i:]), CHURN, _MEASURES, _SHOWN, _RERANKED))
def rank_agreement(spark, sf):
    return st.rank_agreement(_categories(spark, sf), list(_NAMES))


_COV = ["age", "credit_score", "balance", "tenure"]


def _smd(name: str, w: str) -> str:
    one = lambda c: f"""SELECT '{c}' AS covariate, CASE WHEN sqrt((v1 + v0) / 2) > 0 THEN (m1 - m0) / sqrt((v1 + v0) / 2) ELSE 0 END AS s FROM (
      SELECT max(v) FILTER (t = 1) AS v1, max(v) FILTER (t = 0) AS v0, max(m) FILTER (t = 1) AS m1, max(m) FILTER (t = 0) AS m0 FROM (
        SELECT t, m, sum({w} * power({c} - m, 2)) / sum({w}) AS v FROM wc JOIN (SELECT t, sum({w} * {c}) / sum({w}) AS m FROM wc GROUP BY t) USING (t) GROUP BY t, m))"""  # noqa: E731
    return f"SELECT covariate, round(s, 6) AS {name} FROM (" + " UNION ALL ".join(one(c) for c in _COV) + ")"


_WC = ("wc", "SELECT *, 1.0::DOUBLE AS one, CASE WHEN t = 1 THEN (SELECT CAST(sum(t) AS DOUBLE) / count(*) FROM causal) / e ELSE (1 - (SELECT CAST(sum(t) AS DOUBLE) / count(*) FROM causal)) / (1 - e) END AS w FROM causal")


@query("smd_before", with_views(_smd("smd", "one"), CHURN, CAUSAL, _WC))
def smd_before(spark, sf):
    return st.smd(causal(spark, sf), _COV, "t")


@query("smd_weighted", with_views(f"SELECT a.covariate, smd_before, smd_after FROM ({_smd('smd_before', 'one')}) a JOIN ({_smd('smd_after', 'w')}) b ON a.covariate = b.covariate", CHURN, CAUSAL, _WC))
def smd_weighted(spark, sf):
    return st.balance(cs.with_weights(causal(spark, sf)), _COV, "t", F.col("w"))


# ---- evaluation ------------------------------------------------------------

_CUM = ("cum", """SELECT p, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w - sum(pos) OVER w AS fp, (SELECT sum(y) FROM scored) AS tot_pos, (SELECT count(*) - sum(y) FROM scored) AS tot_neg
  FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")


@query("roc_points", with_views("SELECT p, CAST(fp AS DOUBLE) / tot_neg AS fpr, CAST(tp AS DOUBLE) / tot_pos AS tpr FROM cum", SCORED, _CUM))
def roc_points(spark, sf):
    return mt.roc_points(scored(spark, sf))


@query("roc_auc", with_views("SELECT auc, 2 * auc - 1 AS gini FROM (SELECT CAST(sum(pos * (2 * (tot_neg - fp) + (n - pos))) AS DOUBLE) / (2.0::DOUBLE * tot_pos * tot_neg) AS auc FROM cum GROUP BY tot_pos, tot_neg)", SCORED, _CUM))
def roc_auc(spark, sf):
    return mt.roc_auc(scored(spark, sf))


_PR = "CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / tot_pos AS recall"


@query("pr_points", with_views(f"SELECT p, precision, recall, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM (SELECT p, {_PR} FROM cum)", SCORED, _CUM))
def pr_points(spark, sf):
    return mt.pr_points(scored(spark, sf))


@query("avg_precision", with_views("SELECT round(sum(CAST(pos AS DOUBLE) / tot_pos * tp / (tp + fp)), 6) AS avg_precision FROM cum", SCORED, _CUM))
def avg_precision(spark, sf):
    return mt.average_precision(scored(spark, sf))


@query("f1_optimal", with_views(f"SELECT p AS threshold, round(f1, 6) AS f1 FROM (SELECT p, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM (SELECT p, {_PR} FROM cum)) ORDER BY f1 DESC, p LIMIT 1", SCORED, _CUM))
def f1_optimal(spark, sf):
    return mt.f1_optimal(scored(spark, sf)).select("threshold", "f1")


@query("brier", with_views("SELECT round(avg(power(p - y, 2)), 6) AS brier FROM scored", SCORED))
def brier(spark, sf):
    return mt.brier(scored(spark, sf))


@query("confusion", with_views("SELECT y, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY ALL", SCORED))
def confusion(spark, sf):
    return mt.confusion(scored(spark, sf))


_FOUR = ("c", "SELECT CAST(count(*) FILTER (y = 1 AND p >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND p >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND p < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND p < 0.5) AS DOUBLE) AS tn FROM scored")
_BOTH = ("r", "SELECT '0' AS label, tn / (tn + fn) AS p, tn / (tn + fp) AS q, tn + fp AS s FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c")
_F = ("f", "SELECT label, p, q, 2 * p * q / (p + q) AS f, s FROM r")


@query("class_report", with_views("""SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM (SELECT * FROM f
  UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, tp + tn + fp + fn AS n FROM c) UNION ALL SELECT 'macro', avg(p), avg(q), avg(f), sum(s) FROM f
  UNION ALL SELECT 'weighted', sum(p * s) / sum(s), sum(q * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM f)""", SCORED, _FOUR, _BOTH, _F))
def class_report(spark, sf):
    return mt.class_report(scored(spark, sf))


@query("reliability_quantile", with_views("SELECT CAST(bin AS INTEGER) AS bin, round(avg(p), 6) AS mean_p, CAST(sum(y) AS DOUBLE) / count(*) AS rate, count(*) AS n FROM b GROUP BY bin", SCORED, ("b", decile_bin("p", "scored"))))
def reliability_quantile(spark, sf):
    return mt.reliability(scored(spark, sf))


@query("mean_vs_prevalence", with_views("SELECT round(avg(p), 6) AS mean_p, CAST(sum(y) AS DOUBLE) / count(*) AS prevalence FROM scored", SCORED))
def mean_vs_prevalence(spark, sf):
    return mt.mean_vs_prevalence(scored(spark, sf))


# ---- decision --------------------------------------------------------------

_GRID = ("grid", "SELECT 10 + i * 5 AS milli, (10 + i * 5) / 1000.0::DOUBLE AS threshold FROM range(197) t(i)")
_CONT = ("cont", "SELECT milli, threshold, count(s.id) AS contacted, CAST(coalesce(sum(s.y), 0) AS BIGINT) AS churners FROM grid LEFT JOIN scored s ON s.p >= threshold GROUP BY ALL")


@query("breakeven", "SELECT 50.0::DOUBLE / (0.3::DOUBLE * 2000.0::DOUBLE) AS threshold")
def breakeven(spark, sf):
    return dc.breakeven(spark)


@query("profit_curve", with_views("SELECT threshold, contacted, churners, round(0.3::DOUBLE * 2000 * churners - 50 * contacted, 6) AS profit FROM cont", SCORED, _GRID, _CONT))
def profit_curve(spark, sf):
    return dc.profit_curve(scored(spark, sf))


@query("best_threshold", with_views("SELECT threshold, round(0.3::DOUBLE * 2000 * churners - 50 * contacted, 6) AS profit FROM cont ORDER BY profit DESC, threshold LIMIT 1", SCORED, _GRID, _CONT))
def best_threshold(spark, sf):
    return dc.best_threshold(dc.profit_curve(scored(spark, sf)))


@query("policy_compare", with_views("""SELECT policy, th AS threshold, count(s.id) AS contacted, CAST(coalesce(sum(s.y), 0) AS BIGINT) AS churners, round(0.3::DOUBLE * 2000 * coalesce(sum(s.y), 0) - 50 * count(s.id), 6) AS profit FROM (
  SELECT 'optimal' AS policy, (SELECT threshold FROM cont ORDER BY round(0.3::DOUBLE * 2000 * churners - 50 * contacted, 6) DESC, threshold LIMIT 1) AS th UNION ALL SELECT 'breakeven', 50.0::DOUBLE / (0.3::DOUBLE * 2000.0::DOUBLE) UNION ALL SELECT 'half', 0.5 UNION ALL SELECT 'everyone', 0.0)
  LEFT JOIN scored s ON s.p >= th GROUP BY ALL""", SCORED, _GRID, _CONT))
def policy_compare(spark, sf):
    return dc.policies(scored(spark, sf))


@query("profit_sensitivity", with_views("""SELECT accept, value, threshold, round(profit - (accept * value * (SELECT sum(y) FROM scored) - 50 * (SELECT count(*) FROM scored)), 6) AS advantage FROM (
  SELECT a.a AS accept, v.v AS value, threshold, round(a.a * v.v * churners - 50 * contacted, 6) AS profit, row_number() OVER (PARTITION BY a.a, v.v ORDER BY round(a.a * v.v * churners - 50 * contacted, 6) DESC, threshold) AS rn
  FROM cont, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS a) a, (SELECT unnest([500, 1000, 1500, 2000, 3000]::DOUBLE[]) AS v) v) WHERE rn = 1""", SCORED, _GRID, _CONT))
def profit_sensitivity(spark, sf):
    return dc.sensitivity(scored(spark, sf))


@query("campaign_sizing", with_views("""SELECT n AS n_customers, contacted, reached, CAST(reached AS DOUBLE) / churners AS reach, round(0.3::DOUBLE * reached, 6) AS saves, round(50.0::DOUBLE * contacted, 6) AS budget, round(0.3::DOUBLE * reached * 2000, 6) AS value,
  round(0.3::DOUBLE * reached * 2000 - 50.0::DOUBLE * contacted, 6) AS profit, round((0.3::DOUBLE * reached * 2000 - 50.0::DOUBLE * contacted) / (50.0::DOUBLE * contacted), 6) AS roi
  FROM (SELECT count(*) AS n, count(*) FILTER (p >= 0.4) AS contacted, count(*) FILTER (p >= 0.4 AND y = 1) AS reached, sum(y) AS churners FROM scored)""", SCORED))
def campaign_sizing(spark, sf):
    return dc.campaign(scored(spark, sf), 0.4)


_SEG = ("seg", "SELECT *, CAST(customer_id % 3 AS INTEGER) AS cluster FROM rfm")
_PROF = ("prof", "SELECT cluster, count(*) AS n, " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) AS median_{c}" for c in ("recency", "frequency", "monetary")) + ", CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS customer_share, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(sum(CAST(monetary AS DECIMAL(18,2)))) OVER () AS DOUBLE) AS revenue_share FROM seg GROUP BY cluster")


def _segments(spark, sf):
    return ft.rfm(clean_txn(spark, sf)).withColumn("cluster", (F.col("customer_id") % 3).cast("int"))


@query("segment_profile", with_views("SELECT * FROM prof", TXN, CLEAN, ("rfm", RFM_SQL), _SEG, _PROF))
def segment_profile(spark, sf):
    return dc.segment_profile(_segments(spark, sf), "cluster")


@query("segment_name", with_views("SELECT cluster, CASE WHEN median_frequency >= 3 THEN 'core' WHEN median_recency <= 60 THEN 'recent' ELSE 'hibernating' END AS segment_name FROM prof", TXN, CLEAN, ("rfm", RFM_SQL), _SEG, _PROF))
def segment_name(spark, sf):
    return dc.name_segments(dc.segment_profile(_segments(spark, sf), "cluster")).select("cluster", "segment_name")


@query("revenue_share", with_views("SELECT cluster, customer_share, revenue_share FROM prof", TXN, CLEAN, ("rfm", RFM_SQL), _SEG, _PROF))
def revenue_share(spark, sf):
    return dc.segment_profile(_segments(spark, sf), "cluster").select("cluster", "customer_share", "revenue_share")


# ---- credit loss -----------------------------------------------------------

_G = ("g", "SELECT grade, CAST(sum(CAST(pd12 AS DECIMAL(18,6))) AS DOUBLE) / count(pd12) AS orig_pd FROM loans GROUP BY grade")
_MAT = "CASE intent WHEN 'AUTOMOBILE' THEN 5 WHEN 'BUILDING' THEN 7 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END"
_LGD = "CASE home WHEN 'OWN' THEN 0.35::DOUBLE WHEN 'MORTGAGE' THEN 0.4::DOUBLE WHEN 'RENT' THEN 0.55::DOUBLE WHEN 'OTHER' THEN 0.5::DOUBLE END"


def _book(name: str, backstop: str) -> tuple[str, str]:
    return name, f"SELECT *, amount AS ead, {_MAT} AS m, {_LGD} AS lgd, coalesce(int_rate, 10.0) / 100 AS eir, CASE WHEN pd12 >= 0.6 THEN 3 WHEN pd12 >= 2 * orig_pd OR pd12 >= {backstop} THEN 2 ELSE 1 END AS stage FROM loans JOIN g USING (grade)"


def _ecl(pd: str = "1.0", lgd: str = "0.0") -> str:
    p, q = f"least(pd12 * {pd}::DOUBLE, 1.0::DOUBLE)", f"least(lgd + {lgd}::DOUBLE, 1.0::DOUBLE)"
    return f"round(CASE WHEN stage = 1 THEN {p} * {q} * ead * power(1 + eir, -0.5::DOUBLE) ELSE (1 - power(1 - {p}, m)) * {q} * ead * power(1 + eir, -m / 2.0::DOUBLE) END, 4)"


def _sum(e: str) -> str:
    return f"CAST(sum(CAST({e} AS DECIMAL(18,4))) AS DOUBLE)"


_BOOK = _book("book", "0.2")


@query("orig_pd", with_views("SELECT grade, orig_pd FROM g", LOANS, _G))
def orig_pd(spark, sf):
    return cr.orig_pd(loans(spark, sf)).select("grade", "orig_pd").distinct()


@query("staging", with_views("SELECT loan_id, stage FROM book", LOANS, _G, _BOOK))
def staging(spark, sf):
    return cr.book(loans(spark, sf)).select("loan_id", "stage")


@query("ecl_loan", with_views(f"SELECT loan_id, {_ecl()} AS ecl FROM book", LOANS, _G, _BOOK))
def ecl_loan(spark, sf):
    return cr.loan_ecl(cr.book(loans(spark, sf))).select("loan_id", "ecl")


@query("ecl_stage_table", with_views(f"""SELECT stage, count(*) AS n_loans, CAST(sum(CAST(ead AS DECIMAL(18,2))) AS DOUBLE) AS ead, CAST(sum(CAST(pd12 AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS mean_pd, {_sum(_ecl())} AS ecl,
  CAST(sum(CAST(ead AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(sum(CAST(ead AS DECIMAL(18,2)))) OVER () AS DOUBLE) AS ead_share, {_sum(_ecl())} / CAST(sum(CAST(ead AS DECIMAL(18,2))) AS DOUBLE) AS coverage FROM book GROUP BY stage""", LOANS, _G, _BOOK))
def ecl_stage_table(spark, sf):
    return cr.stage_table(cr.book(loans(spark, sf)))


@query("coverage_by_grade", with_views(f"SELECT grade, {_sum(_ecl())} / CAST(sum(CAST(ead AS DECIMAL(18,2))) AS DOUBLE) AS coverage, count(*) AS n_loans FROM book GROUP BY grade", LOANS, _G, _BOOK))
def coverage_by_grade(spark, sf):
    return cr.coverage_by(cr.book(loans(spark, sf)), "grade")


_MONO = f"SELECT CAST(count(*) FILTER (coverage < before) = 0 AS INTEGER) AS is_monotone FROM (SELECT coverage, lag(coverage) OVER (ORDER BY grade) AS before FROM (SELECT grade, {_sum(_ecl())} / CAST(sum(CAST(ead AS DECIMAL(18,2))) AS DOUBLE) AS coverage FROM book GROUP BY grade))"


@query("grade_monotone", with_views(_MONO, LOANS, _G, _BOOK))
def grade_monotone(spark, sf):
    return st.monotone(cr.coverage_by(cr.book(loans(spark, sf)), "grade"), "grade", "coverage")


_SC = ("sc", f"SELECT 'base' AS scenario, 0.5::DOUBLE AS weight, {_sum(_ecl())} AS ecl FROM book UNION ALL SELECT 'adverse', 0.3, {_sum(_ecl('1.5', '0.1'))} FROM book UNION ALL SELECT 'favourable', 0.2, {_sum(_ecl('0.8', '(-0.05)'))} FROM book")


@query("ecl_scenarios", with_views("SELECT * FROM sc", LOANS, _G, _BOOK, _SC))
def ecl_scenarios(spark, sf):
    return cr.scenarios(cr.book(loans(spark, sf)))


@query("ecl_weighted", with_views("SELECT w AS weighted_ecl, b AS base_ecl, round(w / b - 1, 6) AS uplift FROM (SELECT round(sum(weight * ecl), 6) AS w, max(ecl) FILTER (scenario = 'base') AS b FROM sc)", LOANS, _G, _BOOK, _SC))
def ecl_weighted(spark, sf):
    return cr.weighted(cr.book(loans(spark, sf)))


_TIGHT = _book("tight", "0.15")
_VAR = ("var", f"""SELECT 'lgd_up' AS variant, {_sum(_ecl('1.0', '0.1'))} AS e FROM book UNION ALL SELECT 'lgd_down', {_sum(_ecl('1.0', '(-0.1)'))} FROM book UNION ALL SELECT 'pd_up', {_sum(_ecl('1.2'))} FROM book UNION ALL SELECT 'pd_down', {_sum(_ecl('0.8'))} FROM book
  UNION ALL SELECT 'adverse_weight', {_sum(_ecl())} * 0.3::DOUBLE + {_sum(_ecl('1.5', '0.1'))} * 0.5::DOUBLE + {_sum(_ecl('0.8', '(-0.05)'))} * 0.2::DOUBLE FROM book UNION ALL SELECT 'backstop', {_sum(_ecl())} FROM tight""")


@query("ecl_sensitivity", with_views("SELECT variant, round(e, 4) AS ecl, round(e - b, 4) AS delta, round(e / b - 1, 6) AS delta_pct FROM var, (SELECT ecl AS b FROM sc WHERE scenario = 'base')", LOANS, _G, _BOOK, _TIGHT, _SC, _VAR))
def ecl_sensitivity(spark, sf):
    return cr.sensitivity(loans(spark, sf))


# ---- causal ----------------------------------------------------------------


@query("naive_diff", with_views("SELECT a AS treated, b AS control, a - b AS effect FROM (SELECT CAST(sum(y) FILTER (t = 1) AS DOUBLE) / count(*) FILTER (t = 1) AS a, CAST(sum(y) FILTER (t = 0) AS DOUBLE) / count(*) FILTER (t = 0) AS b FROM causal)", CHURN, CAUSAL))
def naive_diff(spark, sf):
    return cs.naive(causal(spark, sf))


@query("ipw_weights", with_views("SELECT id, round(w, 6) AS w FROM wc", CHURN, CAUSAL, _WC))
def ipw_weights(spark, sf):
    return cs.with_weights(causal(spark, sf)).select("id", F.round("w", 6).alias("w"))


@query("ess", with_views("SELECT t, count(*) AS n, round(power(sum(w), 2) / sum(power(w, 2)), 6) AS ess, round(min(w), 6) AS min_w, round(max(w), 6) AS max_w FROM wc GROUP BY t", CHURN, CAUSAL, _WC))
def ess(spark, sf):
    return cs.weight_summary(causal(spark, sf))


@query("ipw_ate", with_views("SELECT round(sum(w * y) FILTER (t = 1) / sum(w) FILTER (t = 1) - sum(w * y) FILTER (t = 0) / sum(w) FILTER (t = 0), 6) AS ate FROM wc", CHURN, CAUSAL, _WC))
def ipw_ate(spark, sf):
    return cs.ipw(causal(spark, sf))


_L = "ln({c} / (1 - {c}))"


@query("caliper_match", with_views(f"""SELECT count(*) AS n_matched, round(avg(ty - y), 6) AS atu FROM (SELECT y, ty, abs({_L.format(c='e')} - {_L.format(c='te')}) AS d, row_number() OVER (PARTITION BY id ORDER BY abs({_L.format(c='e')} - {_L.format(c='te')}), te) AS rn
  FROM causal, (SELECT e AS te, avg(CAST(y AS DOUBLE)) AS ty FROM causal WHERE t = 1 GROUP BY e) WHERE t = 0) WHERE rn = 1 AND d <= 0.2 * (SELECT stddev_pop({_L.format(c='e')}) FROM causal)""", CHURN, CAUSAL))
def caliper_match(spark, sf):
    return cs.caliper_match(causal(spark, sf))


@query("propensity_fit")
def propensity_fit(spark, sf):
    return cs.propensity_overlap(causal(spark, sf), _COV)


@query("propensity_histogram")
def propensity_histogram(spark, sf):
    """Overlap of the fitted propensities by treatment."""
    return cs.overlap_histogram(cs.propensity(causal(spark, sf), _COV))


@query("given_propensity_histogram", with_views("SELECT t, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY t) * max(w)), 6) AS density FROM (SELECT t, w, least(CAST(floor((e - lo) / w) AS INTEGER), 39) AS bin FROM causal, (SELECT min(e) AS lo, (max(e) - min(e)) / 40 AS w FROM causal)) GROUP BY t, bin", CHURN, CAUSAL))
def given_propensity_histogram(spark, sf):
    return cs.overlap_histogram(causal(spark, sf))


_CONF_NUM = ["credit_score", "age", "tenure", "balance", "num_products", "has_card", "salary"]
_CONF_CAT = {"geography": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "gender": ["Female", "Male"], "num_products": [1, 2, 3, 4]}


def _dummies(c: str) -> str:
    text = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f'CAST({c} = {text(v)} AS DOUBLE) AS "{c}_{v}"' for v in sorted(_CONF_CAT[c])[1:])


@query("confounder_matrix", with_views("SELECT customer_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _CONF_NUM) + ", CAST(balance = 0 AS DOUBLE) AS zero_balance, " + ", ".join(_dummies(c) for c in _CONF_CAT) + " FROM churn", CHURN))
def confounder_matrix(spark, sf):
    m, names = cs.confounders(churn(spark, sf), _CONF_NUM, "balance", _CONF_CAT)
    return m.select("customer_id", *(f"`{n}`" for n in names))


@query("balance_sorted", with_views(f"SELECT covariate, smd, row_number() OVER (ORDER BY abs(smd) DESC, covariate) AS pos FROM ({_smd('smd', 'one')})", CHURN, CAUSAL, _WC))
def balance_sorted(spark, sf):
    """Mean differences, the largest in absolute value first (a row per covariate)."""
    from pyspark.sql import Window as W

    return st.smd(causal(spark, sf), _COV, "t").withColumn("pos", F.row_number().over(W.orderBy(F.abs("smd").desc(), "covariate")).cast("long")).orderBy("pos")


@query("gcomp")
def gcomp(spark, sf):
    return cs.g_computation(causal(spark, sf), _COV)


@query("adjusted_or")
def adjusted_or(spark, sf):
    return cs.adjusted_odds(causal(spark, sf), _COV)


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return cs.bootstrap_ipw(causal(spark, sf), _COV)


@query("confounder_dummies", with_views("SELECT customer_id, " + ", ".join(f"CAST(num_products = {v} AS INTEGER) AS num_products_{v}" for v in (2, 3, 4)) + " FROM churn", CHURN))
def confounder_dummies(spark, sf):
    return ft.one_hot(churn(spark, sf), "num_products", [1, 2, 3, 4]).select("customer_id", "num_products_2", "num_products_3", "num_products_4")
