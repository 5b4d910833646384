"""Report queries that combine operators: elbow, standardised segment means, tails, attribution views, effect table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import base_feature
from ..operators import causal as cs
from ..operators import cluster as cl
from ..operators import features as ft
from ..operators import models as md
from ..operators import profile as pr
from ..operators import quality as ql
from ..operators import search as se
from ..operators import stats as st
from ..operators.trees import attributions
from ..session import cut_lineage
from .audits import RFM_SQL
from .models import _D, _V, ENC, _data
from .registry import query, with_views
from .scores import _COV, _WC, _smd
from .views import CAUSAL, CHURN, CLEAN, LOANS, TXN, causal, clean_txn, loans, vectors


@query("missing_columns", with_views("SELECT * FROM (SELECT 'emp_length' AS column_name, count(*) FILTER (emp_length IS NULL) AS n_missing FROM loans UNION ALL SELECT 'int_rate', count(*) FILTER (int_rate IS NULL) FROM loans UNION ALL SELECT 'grade', count(*) FILTER (grade IS NULL) FROM loans) WHERE n_missing > 0", LOANS))
def missing_columns(spark, sf):
    return ql.null_counts(loans(spark, sf), ["emp_length", "int_rate", "grade"], only_missing=True)


@query("kdist_tail", with_views("SELECT i AS id, round(dist, 6) AS k_dist FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, i <> j, j) AS rn FROM d) WHERE rn = 10 ORDER BY k_dist DESC, id LIMIT 800", _V, _D))
def kdist_tail(spark, sf):
    """The last 800 points of the sorted k-distance curve (a report of fixed length)."""
    return cl.k_distance(vectors(spark, sf), 10).orderBy(F.col("k_dist").desc(), "id").limit(800)


@query("elbow_table")
def elbow_table(spark, sf):
    """k, inertia, mean silhouette and smallest cluster for k = 2 to 10, ten starts each."""
    return cl.elbow(vectors(spark, sf), list(range(2, 11)), 10)


_SEG = ("z", "SELECT customer_id % 3 AS cluster, " + ", ".join(f"({c} - (SELECT avg({c}) FROM rfm)) / (SELECT stddev_pop({c}) FROM rfm) AS {c}" for c in ("recency", "frequency", "monetary")) + " FROM rfm")


@query("segment_zscores", with_views("SELECT cluster, round(avg(recency), 5) + 0.0::DOUBLE AS recency, round(avg(frequency), 5) + 0.0::DOUBLE AS frequency, round(avg(monetary), 5) + 0.0::DOUBLE AS monetary FROM z GROUP BY cluster", TXN, CLEAN, ("rfm", RFM_SQL), _SEG))
def segment_zscores(spark, sf):
    """Mean of standardised features by segment."""
    cols = ["recency", "frequency", "monetary"]
    r = ft.rfm(clean_txn(spark, sf))
    whole = r.agg(*(x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))))
    means = r.groupBy((F.col("customer_id") % 3).alias("cluster")).agg(*(F.avg(c).alias(c) for c in cols))
    return means.crossJoin(F.broadcast(whole)).select("cluster", *((F.round(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")), 5) + 0.0).alias(c) for c in cols))


@query("top5_customers", with_views("SELECT customer_id, monetary FROM rfm ORDER BY monetary DESC, customer_id LIMIT 5", TXN, CLEAN, ("rfm", RFM_SQL)))
def top5_customers(spark, sf):
    return pr.top_k(ft.rfm(clean_txn(spark, sf)).select("customer_id", "monetary"), "monetary", 5, "customer_id")


@query("groups_with_many", with_views("SELECT grade, count(*) AS n FROM loans WHERE home IN ('RENT', 'OWN') GROUP BY grade HAVING count(*) > 10", LOANS))
def groups_with_many(spark, sf):
    return loans(spark, sf).where(F.col("home").isin("RENT", "OWN")).groupBy("grade").agg(F.count("*").alias("n")).where("n > 10")


@query("max_abs_smd", with_views(f"SELECT max(abs(smd_after)) AS max_abs_smd FROM ({_smd('smd_after', 'w')})", CHURN, CAUSAL, _WC))
def max_abs_smd(spark, sf):
    return st.smd(cs.with_weights(causal(spark, sf)), _COV, "t", F.col("w")).agg(F.max(F.abs("smd")).alias("max_abs_smd"))


@query("effect_table")
def effect_table(spark, sf):
    """Four estimators of one effect, in percentage points."""
    d = cut_lineage(causal(spark, sf))
    rows = [("naive", cs.naive(d).select("effect")), ("ipw", cs.ipw(d)), ("matching_atu", cs.caliper_match(d).select("atu")), ("g_computation", cs.g_computation(d, _COV))]
    out = None
    for name, r in rows:
        x = r.select(F.lit(name).alias("estimator"), (F.col(r.columns[0]) * 100).alias("effect_pp"))
        out = x if out is None else out.unionByName(x)
    return out


@query("shap_dependence")
def shap_dependence(spark, sf):
    """Value and attribution of one feature, with another feature for colour."""
    s = md.linear_shap(_data(spark, sf), "customer_id", ENC)
    other = s.where(F.col("feature") == "num__balance").select("customer_id", F.col("x").alias("colour"))
    return s.where(F.col("feature") == "num__age").select("customer_id", "x", "phi").join(other, "customer_id")


@query("shap_by_level")
def shap_by_level(spark, sf):
    """Box-plot numbers of a dummy's own attribution where the dummy is 1, by level."""
    s = md.linear_shap(_data(spark, sf), "customer_id", ENC)
    return pr.five_numbers(s.where(F.col("feature").startswith("cat__") & (F.col("x") == 1)), "phi", "feature")


@query("rank_model_vs_statistics")
def rank_model_vs_statistics(spark, sf):
    """Agreement of five importance measures over source columns: information value, Cramer's V, mutual information, mean |SHAP| and gain."""
    d = _data(spark, sf)
    wide, _, rows, model = se.trained(d, "customer_id", ENC)
    base = lambda c: base_feature(F.col(c), ENC[1])
    gains = spark.createDataFrame([(wide.names[f], g * n) for f, g, n in model.gains()], "feature string, gain double").groupBy(base("feature").alias("feature")).agg(F.sum("gain").alias("gain"))
    shap = md.mean_abs_shap(attributions(rows, wide.names, model, "customer_id"), ENC[1]).withColumnRenamed("importance", "mean_abs_shap")
    stat = st.association_table(d, *ENC, "y").select("feature", "iv", "cramers_v", "mutual_info")
    both = stat.join(gains, "feature", "left").join(shap, "feature", "left").fillna(0.0, ["gain", "mean_abs_shap"])  # a row per feature
    return st.rank_agreement(both, ["iv", "cramers_v", "mutual_info", "mean_abs_shap", "gain"])
