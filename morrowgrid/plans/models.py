"""Cluster, projection, supervised and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import decision as dc
from ..operators import features as ft
from ..operators import models as md
from ..operators import profile as pr
from ..operators import search as se
from ..operators.calibration import isotonic_blocks
from ..operators.trees import attributions
from ..session import cut_lineage
from .audits import RFM_SQL
from .registry import query, with_views
from .views import CHURN, CLEAN, SCORED, TXN, churn, clean_txn, scored, vectors

# ---- vectors ---------------------------------------------------------------

EPS, MIN_SAMPLES = 1.2, 10
_V = ("v", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings")
_D = ("d", "SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda x: power(x[1] - x[2], 2)))) AS dist FROM v a, v b")


@query("knn_distance", with_views("SELECT i AS id, round(dist, 6) AS k_dist FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, i <> j, j) AS rn FROM d) WHERE rn = 10", _V, _D))
def knn_distance(spark, sf):
    return cl.k_distance(vectors(spark, sf), 10)


@query("kdist_percentiles", with_views("SELECT CAST(p AS INTEGER) AS pct, round(quantile_cont(k, [0.5, 0.75, 0.9, 0.95, 0.99])[idx], 5) AS k_dist FROM (SELECT i, round(dist, 6) AS k FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, i <> j, j) AS rn FROM d) WHERE rn = 10), (VALUES (50, 1), (75, 2), (90, 3), (95, 4), (99, 5)) t(p, idx) GROUP BY p, idx", _V, _D))
def kdist_percentiles(spark, sf):
    return cl.k_distance_percentiles(vectors(spark, sf), 10)


@query("eps_neighbours", with_views(f"SELECT i AS id, count(*) FILTER (dist <= {EPS}) AS n_neighbours FROM d GROUP BY i", _V, _D))
def eps_neighbours(spark, sf):
    return cl.eps_degree(vectors(spark, sf), EPS)


@query("dbscan_core", with_views(f"SELECT i AS id, count(*) FILTER (dist <= {EPS}) AS n_neighbours, CAST(count(*) FILTER (dist <= {EPS}) >= {MIN_SAMPLES} AS INTEGER) AS is_core FROM d GROUP BY i", _V, _D))
def dbscan_core(spark, sf):
    return cl.dbscan_core(vectors(spark, sf), EPS, MIN_SAMPLES)


_DBSCAN = f"""WITH RECURSIVE {_V[0]} AS ({_V[1]}), {_D[0]} AS ({_D[1]}), core AS (SELECT i FROM d WHERE dist <= {EPS} GROUP BY i HAVING count(*) >= {MIN_SAMPLES}),
  e AS (SELECT i, j FROM d WHERE dist <= {EPS} AND i IN (FROM core) AND j IN (FROM core)),
  reach(i, l) AS (SELECT i, i FROM core UNION SELECT e.j, reach.l FROM reach JOIN e ON reach.i = e.i),
  lab AS (SELECT i, min(l) AS l FROM reach GROUP BY i),
  fix AS (SELECT i, l FROM lab)
  SELECT v.id, coalesce((SELECT l FROM fix WHERE fix.i = v.id), (SELECT min(fix.l) FROM d JOIN fix ON d.j = fix.i WHERE d.i = v.id AND d.dist <= {EPS}), -1) AS label FROM v"""


@query("dbscan_labels", _DBSCAN)
def dbscan_labels(spark, sf):
    return cl.dbscan(vectors(spark, sf), EPS, MIN_SAMPLES)


_RFM_Z = ("rz", "SELECT customer_id, " + ", ".join(f"round((ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM rfm)) / (SELECT stddev_samp(ln(1 + {c})) FROM rfm), 6) AS {c}_z" for c in ("recency", "frequency", "monetary")) + " FROM rfm")
_RFM_D = ("rd", "SELECT a.customer_id AS i, b.customer_id AS j, sqrt(power(a.recency_z - b.recency_z, 2) + power(a.frequency_z - b.frequency_z, 2) + power(a.monetary_z - b.monetary_z, 2)) AS dist FROM rz a, rz b")
#: The series' radii and the one it settles on.
EPS_GRID, EPS_FINAL = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2), 0.7
_EPS = ("eps", "SELECT unnest([" + ", ".join(f"{e}::DOUBLE" for e in EPS_GRID) + "]) AS eps")
_RFM_CORE = ("rc", f"SELECT eps, i FROM rd, eps WHERE dist <= eps GROUP BY eps, i HAVING count(*) >= {MIN_SAMPLES}")
_RFM_NOISE = ("rn", "SELECT e.eps, z.customer_id AS id, CAST(c.i IS NOT NULL AS INTEGER) AS is_core, CAST(n.i IS NULL AS INTEGER) AS is_noise FROM rz z CROSS JOIN eps e LEFT JOIN rc c ON c.eps = e.eps AND c.i = z.customer_id LEFT JOIN (SELECT DISTINCT rc.eps, rd.i FROM rd JOIN rc ON rd.j = rc.i AND rd.dist <= rc.eps) n ON n.eps = e.eps AND n.i = z.customer_id")
_RFM_VIEWS = (TXN, CLEAN, ("rfm", RFM_SQL), _RFM_Z, _RFM_D, _EPS, _RFM_CORE, _RFM_NOISE)


def rfm_vectors(spark, sf):
    """Standardised log recency, frequency and money of every customer, as vectors."""
    z = ft.log_zscore(ft.rfm(clean_txn(spark, sf)), "customer_id", ["recency", "frequency", "monetary"])
    return z.select(F.col("customer_id").alias("id"), F.array("recency_z", "frequency_z", "monetary_z").alias("features"))


@query("dbscan_noise_scan", with_views("SELECT eps, CAST(sum(is_core) AS BIGINT) AS n_core, CAST(sum(is_noise) AS BIGINT) AS n_noise FROM rn GROUP BY eps", *_RFM_VIEWS))
def dbscan_noise_scan(spark, sf):
    return cl.dbscan_noise(rfm_vectors(spark, sf), list(EPS_GRID), MIN_SAMPLES).groupBy("eps").agg(F.sum("is_core").cast("long").alias("n_core"), F.sum("is_noise").cast("long").alias("n_noise"))


@query("dbscan_eps_scan")
def dbscan_eps_scan(spark, sf):
    """Clusters, noise, smallest cluster and silhouette at each of the series' radii."""
    return cl.dbscan_scan(rfm_vectors(spark, sf), list(EPS_GRID), MIN_SAMPLES)


@query("silhouette_given_labels", with_views("""SELECT label, count(*) AS n, round(avg(s), 6) AS silhouette FROM (SELECT i, li AS label, coalesce((b - a) / greatest(a, b), 0) AS s FROM (
  SELECT i, li, max(CASE WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM (SELECT i, li, lj, sum(dist) AS t, count(*) AS n FROM d GROUP BY i, li, lj) GROUP BY i, li)) GROUP BY label""", _V, _D))
def silhouette_given_labels(spark, sf):
    return cl.silhouette(vectors(spark, sf)).select(F.col("label").cast("int").alias("label"), "n", "silhouette")


_SIL = """SELECT i AS id, li AS label, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM (
  SELECT i, li, max(CASE WHEN li = lj AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN li <> lj THEN t / n END) AS b FROM (SELECT i, li, lj, sum(dist) AS t, count(*) AS n FROM d GROUP BY i, li, lj) GROUP BY i, li)"""


@query("knife_plot", with_views("SELECT id, CAST(label AS BIGINT) AS label, silhouette, row_number() OVER (PARTITION BY label ORDER BY silhouette, id) AS pos FROM s", _V, _D, ("s", _SIL)))
def knife_plot(spark, sf):
    return cl.knife_plot(vectors(spark, sf)).select("id", "label", "silhouette", "pos")


_FEATURES = ("recency", "frequency", "monetary", "tenure", "n_products", "avg_order_value")


def _rfm_noise(spark, sf):
    """Customers with DBSCAN's noise as label -1 and all others as 0."""
    n = cl.dbscan_noise(rfm_vectors(spark, sf), [EPS_FINAL], MIN_SAMPLES).select(F.col("id").alias("customer_id"), (-F.col("is_noise")).alias("label"))
    return ft.rfm(clean_txn(spark, sf)).join(n, "customer_id")


_NOISY = ("noisy", f"SELECT rfm.*, is_noise FROM rfm JOIN rn ON rn.id = rfm.customer_id WHERE eps = {EPS_FINAL}")


@query("noise_profile", with_views("SELECT is_noise, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS n_share, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(sum(CAST(monetary AS DECIMAL(18,2)))) OVER () AS DOUBLE) AS money_share, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median_{c}" for c in _FEATURES) + " FROM noisy GROUP BY is_noise", *_RFM_VIEWS, _NOISY))
def noise_profile(spark, sf):
    return cl.noise_profile(_rfm_noise(spark, sf), "label", list(_FEATURES), "monetary")


@query("noise_top5", with_views("SELECT customer_id, recency, frequency, monetary FROM noisy WHERE is_noise = 1 ORDER BY monetary DESC, customer_id LIMIT 5", *_RFM_VIEWS, _NOISY))
def noise_top5(spark, sf):
    """The five noise customers who spend most (a report of fixed length)."""
    return pr.top_k(_rfm_noise(spark, sf).where("label = -1").select("customer_id", "recency", "frequency", "monetary"), "monetary", 5, "customer_id")


@query("kdist_curve", with_views("SELECT row_number() OVER (ORDER BY k_dist, id) AS pos, k_dist FROM (SELECT i AS id, round(dist, 6) AS k_dist FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, i <> j, j) AS rn FROM d) WHERE rn = 10)", _V, _D))
def kdist_curve(spark, sf):
    return cl.k_distance_curve(vectors(spark, sf), 10)


@query("kmeans_scan")
def kmeans_scan(spark, sf):
    return cl.kmeans_scan(vectors(spark, sf), list(range(2, 11)), 10)


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    return cl.kmeans_labels(vectors(spark, sf), 5)


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    """Profile and name of the customer segments that k-means with k = 3 finds."""
    lab = cl.kmeans_labels(rfm_vectors(spark, sf), 3).withColumnRenamed("id", "customer_id")
    return dc.name_segments(dc.segment_profile(ft.rfm(clean_txn(spark, sf)).join(lab, "customer_id"), "cluster"))


@query("cluster_compare")
def cluster_compare(spark, sf):
    """k-means (k = 3) against DBSCAN: clusters, share of noise, silhouette, smallest cluster."""
    return cl.compare(rfm_vectors(spark, sf), 3, EPS_FINAL, MIN_SAMPLES).withColumn("silhouette", F.round("silhouette", 3))


@query("pca_evr")
def pca_evr(spark, sf):
    """All components."""
    v = vectors(spark, sf)
    return cl.pca_evr(v, v.select(F.size("features").alias("n")).first()["n"])


@query("pca_loadings")
def pca_loadings(spark, sf):
    return cl.pca_loadings(vectors(spark, sf), 4)


@query("pca_biplot")
def pca_biplot(spark, sf):
    """The vectors of a biplot: loadings of two components, four times as long."""
    return cl.pca_loadings(vectors(spark, sf), 2, 4.0)


@query("pca_scores")
def pca_scores(spark, sf):
    return cl.pca_scores(vectors(spark, sf), 2)


@query("tsne_sample")
def tsne_sample(spark, sf):
    """Three perplexities over a bounded sample."""
    return cl.tsne(vectors(spark, sf))


# ---- supervised ------------------------------------------------------------

ENC = (["age", "credit_score", "balance", "tenure", "salary"], ["geography", "gender"])


def _data(spark, sf):
    """Churn customers, written once since many passes read them."""
    return cut_lineage(churn(spark, sf).withColumnRenamed("exited", "y"))


def _training(spark, sf):
    """The training four fifths."""
    return cut_lineage(ft.stratified_split(churn(spark, sf).withColumnRenamed("exited", "y"), "customer_id", "y").where("is_test = 0").drop("is_test"))


@query("logit_odds")
def logit_odds(spark, sf):
    return md.odds_ratios(_data(spark, sf), "customer_id", ENC)


@query("smote_counts", with_views("SELECT greatest(a, b) AS majority, least(a, b) AS minority, greatest(CAST(floor(0.8 * greatest(a, b)) AS BIGINT) - least(a, b), 0) AS n_new FROM (SELECT count(*) FILTER (exited = 0) AS a, count(*) FILTER (exited = 1) AS b FROM churn)", CHURN))
def smote_counts(spark, sf):
    return md.smote_counts(_data(spark, sf), 0.8)


@query("smote_rows", with_views("SELECT exited AS y, CASE WHEN n = least(a, b) THEN greatest(CAST(floor(0.8 * greatest(a, b)) AS BIGINT), n) ELSE n END AS n FROM (SELECT exited, count(*) AS n FROM churn GROUP BY exited), (SELECT count(*) FILTER (exited = 0) AS a, count(*) FILTER (exited = 1) AS b FROM churn)", CHURN))
def smote_rows(spark, sf):
    return md.smote(_data(spark, sf), "customer_id", ["age", "credit_score", "balance"], 5, 0.8).groupBy("y").agg(F.count("*").alias("n"))


@query("imbalance_compare")
def imbalance_compare(spark, sf):
    return se.strategies(_training(spark, sf), "customer_id", ENC, "logistic")


@query("imbalance_boosted")
def imbalance_boosted(spark, sf):
    return se.strategies(_training(spark, sf), "customer_id", ENC, "level")


@query("imbalance_leafwise")
def imbalance_leafwise(spark, sf):
    return se.strategies(_training(spark, sf), "customer_id", ENC, "leaf")


def _search(kind: str):
    def top5(spark, sf):
        """The five best of 40 random candidates in 5 folds, all in lockstep."""
        return se.top(se.ranked(_training(spark, sf), "customer_id", ENC, kind, se.budgeted(kind)))

    def grid(spark, sf):
        """The refinement around the best of 40 random candidates."""
        return se.two_stage(_training(spark, sf), "customer_id", ENC, kind)

    return top5, grid


for _name, _kind in (("", "logistic"), ("boosted_", "level"), ("leafwise_", "leaf")):
    _top5, _grid = _search(_kind)
    query(f"{_name}random_search_top5")(_top5)
    query(f"{_name}grid_refine")(_grid)


@query("isotonic_map", with_views("""SELECT min(p) AS lo, max(p) AS hi, round(v, 6) AS value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT i, p, n, max(low) AS v FROM (
    SELECT a.i AS a, b.i AS i, b.p, b.n, min((b.s - a.s + a.pos) / (b.m - a.m + a.n)) OVER (PARTITION BY a.i ORDER BY b.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM c a JOIN c b ON b.i >= a.i)
    GROUP BY i, p, n) GROUP BY v""", SCORED, ("c", "SELECT row_number() OVER (ORDER BY p) AS i, p, pos, n, sum(pos) OVER (ORDER BY p) AS s, sum(n) OVER (ORDER BY p) AS m FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scored GROUP BY p)")))
def isotonic_map(spark, sf):
    """The blocks of the isotonic regression of outcomes on scores; in SQL by the min-max formula."""
    return isotonic_blocks(scored(spark, sf)).select("lo", "hi", F.round("value", 6).alias("value"), "n")


@query("isotonic_calibrated")
def isotonic_calibrated(spark, sf):
    """Five pairs of boosted model and isotonic map, averaged."""
    return se.calibrated(_data(spark, sf), "customer_id", ENC)


def _boosted(spark, sf, kind: str = "level"):
    return se.trained(_data(spark, sf), "customer_id", ENC, kind)


@query("gbt_scores")
def gbt_scores(spark, sf):
    """Scores of all customers by level-wise trees that are trained on all of them."""
    return se.scores(_boosted(spark, sf), "customer_id")


@query("leafwise_scores")
def leafwise_scores(spark, sf):
    return se.scores(_boosted(spark, sf, "leaf"), "customer_id")


@query("gbt_distributed")
def gbt_distributed(spark, sf):
    """MLlib's trees, trained on all rows wherever they are; scores of the held-out fifth."""
    return md.train_test(_data(spark, sf), "customer_id", ENC, lambda t: md.boosted(8, depth=3).fit(t))


@query("model_table")
def model_table(spark, sf):
    return se.model_table(_data(spark, sf), "customer_id", ENC)


@query("shap_linear")
def shap_linear(spark, sf):
    return md.linear_shap(_data(spark, sf), "customer_id", ENC)


@query("shap_mean_abs")
def shap_mean_abs(spark, sf):
    return md.mean_abs_shap(md.linear_shap(_data(spark, sf), "customer_id", ENC), ENC[1])


@query("shap_tree")
def shap_tree(spark, sf):
    wide, _, rows, model = _boosted(spark, sf)
    return attributions(rows, wide.names, model, "customer_id")


@query("gain_importance")
def gain_importance(spark, sf):
    """Mean gain per split of each feature."""
    wide, _, _, model = _boosted(spark, sf)
    return spark.createDataFrame([(wide.names[f], g, n) for f, g, n in model.gains()], "feature string, gain double, n_splits int")


@query("event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from ..streaming.rfm_stream import windowed

    return windowed(spark.read.parquet(f"{sf}/events.parquet")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("user_profiles", "SELECT user_id, max(ts) AS last, count(*) AS frequency, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS monetary FROM events GROUP BY user_id")
def user_profiles(spark, sf):
    from ..streaming.rfm_stream import user_profile

    return user_profile(spark.read.parquet(f"{sf}/events.parquet"))
