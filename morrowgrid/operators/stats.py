"""Association measures: chi-square, Cramer's V, Mann-Whitney, weight of evidence, mutual information, mean differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import edge_bins, r6
from ..functions.tails import chi2_p, normal_two_sided
from ..session import cut_lineage
from .profile import crosstab, spearman, with_quantile_bin
from .ranges import cumulated, in_long, quantiles_in_long, rank_tables, with_ranks

#: Distinct values of a class in which neighbours are sought at once.
NEIGHBOUR_BLOCK = 4096


def binned_levels(df: DataFrame, col: str, q: int = 10, missing: str = "MISSING") -> DataFrame:
    """`level`: the decile of a numeric column as text, missing values as a level of their own."""
    return with_quantile_bin(df, col, q, "mg_bin").withColumn("level", F.coalesce(F.col("mg_bin").cast("string"), F.lit(missing))).drop("mg_bin")


def chi2(df: DataFrame, x: str, y: str) -> DataFrame:
    """chi2 (Yates-corrected for one degree of freedom), plain chi2, dof, n and table size, from the contingency table only."""
    c = crosstab(df, x, y)
    rows, cols = c.groupBy(x).agg(F.sum("n").alias("rn")), c.groupBy(y).agg(F.sum("n").alias("cn"))
    total = c.agg(F.sum("n").alias("total"), F.count_distinct(x).alias("r"), F.count_distinct(y).alias("k"))
    e = c.join(rows, x).join(cols, y).crossJoin(F.broadcast(total)).withColumn("e", F.col("rn").cast("double") * F.col("cn") / F.col("total"))
    gap = F.abs(F.col("n") - F.col("e"))
    dof = (F.col("r") - 1) * (F.col("k") - 1)
    yates = gap - F.when(dof == 1, F.least(F.lit(0.5), gap)).otherwise(0.0)
    return e.groupBy("total", "r", "k").agg(F.sum(yates * yates / F.col("e")).alias("chi2"), F.sum(gap * gap / F.col("e")).alias("plain")).select("chi2", "plain", dof.alias("dof"), F.col("total").alias("n"), "r", "k")


def chi2_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """The statistic and its p-value."""
    return chi2(df, x, y).select("chi2", F.col("dof").cast("int").alias("dof"), chi2_p(F.col("chi2"), F.col("dof")).alias("p_value"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """Bias-corrected Cramer's V."""
    c = chi2(df, x, y)
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - ((k - 1) * (r - 1)).cast("double") / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    low = F.least(kc - 1, rc - 1)
    return c.select(r6(F.when(low > 0, F.sqrt(phi / low)).otherwise(0.0)).alias("cramers_v"))


def mann_whitneys(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """One row for each numeric column: U of the positive class from average ranks of distinct values, z with tie and
    continuity correction, two-sided p-value and rank-biserial r; rows where the column or y is missing are left out.

    All columns are ranked in one plan, over distinct values; equal values meet as counts.
    """
    return _mann_whitneys(cut_lineage(in_long(df.where(F.col(y).isNotNull()).withColumn("mg_y", F.col(y).cast("long")), cols, ["mg_y"]).groupBy("mg_i", "mg_v", "mg_y").agg(F.count("*").alias("mg_k"))), cols)


def _mann_whitneys(long: DataFrame, cols: list[str]) -> DataFrame:
    """The same from a written table of counts (mg_i, mg_v, mg_y, mg_k)."""
    per = long.groupBy("mg_i", "mg_v").agg(F.sum("mg_k").alias("m"), F.sum(F.col("mg_k") * F.col("mg_y")).alias("pos"))
    s = per.join(rank_tables(long, "mg_k").select("mg_i", "mg_v", "mg_rank"), ["mg_i", "mg_v"]).groupBy("mg_i").agg(F.sum("m").alias("n"), F.sum("pos").alias("n1"), F.sum(F.col("mg_rank") * F.col("pos")).alias("r1"), F.sum(F.col("m").cast("double") * F.col("m") * F.col("m") - F.col("m")).alias("ties"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(F.try_divide(n1 * n0, F.lit(12.0)) * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, sigma)
    name = F.element_at(F.array(*map(F.lit, cols)), F.col("mg_i") + 1)
    return s.select(name.alias("feature"), u.alias("u"), F.col("n1").alias("n_pos"), n0.cast("long").alias("n_neg"), z.alias("z"), normal_two_sided(z).alias("p_value"), (F.try_divide(2 * u, n1 * n0) - 1).alias("rank_biserial"))


def mann_whitney(df: DataFrame, col: str, y: str) -> DataFrame:
    """U, z and rank-biserial r of one column (see `mann_whitneys`)."""
    return mann_whitneys(df, [col], y).select("u", "n_pos", "n_neg", r6(F.col("z")).alias("z"), r6(F.col("rank_biserial")).alias("rank_biserial"))


def mann_whitney_p(df: DataFrame, col: str, y: str) -> DataFrame:
    return mann_whitneys(df, [col], y).select("u", "p_value")


def woe(levels: DataFrame, level: str, y: str) -> DataFrame:
    """Weight of evidence of each level; class shares are at least 1e-6."""
    g = levels.groupBy(F.col(level).alias("level")).agg(F.count_if(F.col(y) == 0).alias("good"), F.count_if(F.col(y) == 1).alias("bad"))
    total = g.agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"))
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    gs, bs = floor(F.try_divide(F.col("good").cast("double"), F.col("tg"))), floor(F.try_divide(F.col("bad").cast("double"), F.col("tb")))
    w = F.log(gs / bs)
    return g.crossJoin(F.broadcast(total)).select("level", "good", "bad", r6(w).alias("woe"), ((gs - bs) * w).alias("part"))


def information_value(levels: DataFrame, level: str, y: str) -> DataFrame:
    return woe(levels, level, y).agg(r6(F.sum("part")).alias("iv"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Plug-in mutual information of two discrete columns, in nats."""
    c = df.groupBy(x, y).agg(F.count("*").alias("n"))
    px, py = c.groupBy(x).agg(F.sum("n").alias("nx")), c.groupBy(y).agg(F.sum("n").alias("ny"))
    t = c.agg(F.sum("n").alias("t"))
    j = c.join(F.broadcast(px), c[x].eqNullSafe(px[x])).drop(px[x]).join(F.broadcast(py), c[y].eqNullSafe(py[y])).crossJoin(F.broadcast(t))
    n = F.col("n").cast("double")
    return j.agg(r6(F.sum(n / F.col("t") * F.log(n * F.col("t") / (F.col("nx").cast("double") * F.col("ny"))))).alias("mi"))


def moments(df: DataFrame, covariates: list[str], t: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean and population variance of every covariate by treatment, one scan; variance about the mean from shifted sums."""
    w = weight if weight is not None else F.lit(1.0)
    long = df.select(F.col(t).alias("t"), w.alias("w"), F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates))).alias("s")).select("t", "w", "s.*").where("x is not null")
    m = long.groupBy("covariate", "t").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    d = long.join(F.broadcast(m), ["covariate", "t"])
    return d.groupBy("covariate", "t", "m").agg((F.sum(F.col("w") * (F.col("x") - F.col("m")) ** 2) / F.sum("w")).alias("v"))


def smd(df: DataFrame, covariates: list[str], t: str, weight: Column | None = None) -> DataFrame:
    """Standardised mean difference of treated and untreated, 0 where the pooled deviation is 0."""
    m = moments(df, covariates, t, weight)
    one = lambda c, k: F.max(F.when(F.col("t") == k, F.col(c)))
    g = m.groupBy("covariate").agg(one("m", 1).alias("m1"), one("m", 0).alias("m0"), one("v", 1).alias("v1"), one("v", 0).alias("v0"))
    pooled = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return g.select("covariate", r6(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0)).alias("smd"))


def balance(df: DataFrame, covariates: list[str], t: str, weight: Column) -> DataFrame:
    """SMD before and after weighting."""
    return smd(df, covariates, t).withColumnRenamed("smd", "smd_before").join(smd(df, covariates, t, weight).withColumnRenamed("smd", "smd_after"), "covariate")


def rank_agreement(table: DataFrame, measures: list[str]) -> DataFrame:
    """Spearman matrix of importance measures over features: correlation of the shown ranks' ranks."""
    shown = importance_ranks(table, measures).select(*(F.col(f"rank_{c}").alias(c) for c in measures))
    return spearman(shown, measures).select("x", "y", (F.col("r") + 0.0).alias("r"))  # no negative zero


def digamma(n: Column) -> Column:
    """Digamma of a positive number: the recurrence up to n + 6, then the asymptotic series."""
    z = n.cast("double") + 6
    shift = sum((F.lit(1.0) / (n.cast("double") + i) for i in range(1, 6)), F.lit(1.0) / n.cast("double"))
    w = F.lit(1.0) / (z * z)
    return F.log(z) - 0.5 / z - w * (F.lit(1 / 12) - w * (F.lit(1 / 120) - w * (F.lit(1 / 252) - w / 240))) - shift


def _radii(counts: DataFrame, k: int) -> DataFrame:
    """counts (mg_i, mg_v, mg_y, mg_c) with mg_k and mg_r: the distance of each value to its k-th nearest row of its class (mg_k: k, at most the class's other rows).

    Distinct values of a class are numbered and dealt into blocks by number; each goes to the blocks of the k numbers
    before and after it too, so a block holds all neighbours of its own values, and a hot value is one row with a count.
    """
    group = F.concat_ws("|", "mg_i", "mg_y")
    sizes = counts.groupBy("mg_i", "mg_y").agg(F.sum("mg_c").alias("mg_size"))
    numbered = cumulated(cut_lineage(counts.select(group.alias("mg_i"), "mg_v", "mg_y", "mg_c", F.col("mg_i").alias("mg_f"), F.lit(1).alias("mg_1"))), "mg_1")
    home = lambda shift: F.floor((F.col("mg_upto") - 1 + shift) / NEIGHBOUR_BLOCK)
    dealt = numbered.withColumns({"mg_home": home(0), "mg_b": F.explode(F.array_distinct(F.array(home(0), home(-k), home(k))))})
    w = W.partitionBy("mg_i", "mg_b").orderBy("mg_upto")
    beside = [(F.abs(F.col("mg_v") - f("mg_v", j).over(w)), f("mg_c", j).over(w)) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    near = F.array(*(F.struct(d.alias("d"), n.cast("long").alias("n")) for d, n in [(F.lit(0.0), F.col("mg_c") - 1), *beside]))
    own = dealt.withColumn("mg_near", near).where("mg_b = mg_home").select(F.col("mg_f").alias("mg_i"), "mg_v", "mg_y", "mg_c", "mg_near")
    own = own.join(sizes, ["mg_i", "mg_y"]).withColumn("mg_k", F.least(F.lit(k), F.col("mg_size") - 1)).where("mg_k > 0")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("r"))
    nearer = F.array_sort(F.filter("mg_near", lambda x: x["d"].isNotNull()))
    reach = F.aggregate(nearer, start, lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["r"].isNull() & (s["seen"] + x["n"] >= F.col("mg_k")), x["d"]).otherwise(s["r"]).alias("r")))
    return own.select("mg_i", "mg_v", "mg_y", "mg_c", "mg_k", reach["r"].alias("mg_r"))


def mutual_informations_knn(df: DataFrame, cols: list[str], y: str, k: int = 3) -> DataFrame:
    """(mg_i, mi): mutual information of each of several continuous columns and a label by k nearest neighbours, in nats, at least 0; nulls aside.

    A point counts how many points of any class lie nearer than its k-th neighbour of its own class. All columns go
    through one plan over distinct (value, class) counts: the counts inside a radius come from running sums over points
    and interval ends together.
    """
    long = in_long(df.where(F.col(y).isNotNull()).withColumn("mg_y", F.col(y).cast("int")), cols, ["mg_y"])
    return _mutual_informations_knn(cut_lineage(long.groupBy("mg_i", "mg_v", "mg_y").agg(F.count("*").alias("mg_c"))), k)


def _mutual_informations_knn(counts: DataFrame, k: int = 3) -> DataFrame:
    """The same from a written table of counts (mg_i, mg_v, mg_y, mg_c)."""
    r = cut_lineage(_radii(counts, k))
    # nearer by more than rounding, so that the k-th neighbour itself isn't counted
    reach = F.col("mg_r") - F.least(F.col("mg_r"), 1e-9 * F.greatest(F.lit(1.0), F.abs("mg_v")))
    # at equal values a lower end comes before the points and an upper end after them
    event = lambda v, o, n, s: F.struct(v.alias("v"), F.lit(o).alias("o"), n.alias("n"), F.lit(s).alias("s"))
    none = F.lit(0).cast("long")
    events = r.select("mg_i", "mg_y", F.col("mg_v").alias("x"), "mg_c", F.explode(F.array(event(F.col("mg_v"), 1, F.col("mg_c"), 0), event(F.col("mg_v") - reach, 0, none, -1), event(F.col("mg_v") + reach, 2, none, 1))).alias("e"))
    summed = cumulated(cut_lineage(events.select("mg_i", "mg_y", "x", "mg_c", F.col("e.v").alias("mg_v"), "e.o", "e.n", "e.s")), "n", ["o"])
    inside = summed.where("s <> 0").groupBy("mg_i", "mg_y", "x", "mg_c").agg(F.sum(F.col("s") * F.col("mg_upto")).alias("m"))
    mean = lambda v, n: F.sum(n * v) / F.sum(n)
    met = inside.groupBy("mg_i").agg(mean(digamma(F.greatest("m", F.lit(1))), F.col("mg_c")).alias("inside"))
    per = r.groupBy("mg_i", "mg_y", "mg_k").agg(F.sum("mg_c").alias("n"))
    whole = per.groupBy("mg_i").agg(F.sum("n").alias("total"), mean(digamma(F.col("mg_k")), F.col("n")).alias("ks"), mean(digamma(F.col("n")), F.col("n")).alias("ns"))
    return whole.join(met, "mg_i").select("mg_i", F.greatest(F.lit(0.0), digamma(F.col("total")) + F.col("ks") - F.col("ns") - F.col("inside")).alias("mi"))


def mutual_information_knn(df: DataFrame, col: str, y: str, k: int = 3) -> DataFrame:
    """The same for one column; one row."""
    return mutual_informations_knn(df, [col], y, k).agg(r6(F.max("mi")).alias("mi"))


def value_counts(df: DataFrame, numeric: list[str], categorical: list[str], y: str) -> DataFrame:
    """(mg_i, mg_v, level, mg_y, mg_k): how often each value of each feature (a number as mg_v, a text as level, numbers first) occurs with each outcome, by one scan."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    one = [F.struct(F.lit(i).alias("mg_i"), F.col(c).cast("double").alias("mg_v"), text.alias("level")) for i, c in enumerate(numeric)]
    one += [F.struct(F.lit(i).alias("mg_i"), number.alias("mg_v"), F.col(c).cast("string").alias("level")) for i, c in enumerate(categorical, len(numeric))]
    long = df.select(F.explode(F.array(*one)).alias("s"), F.col(y).alias("mg_y")).select("s.*", "mg_y")
    return long.groupBy("mg_i", "mg_v", "level", "mg_y").agg(F.count("*").alias("mg_k"))


def _known(counts: DataFrame, numeric: list[str]) -> DataFrame:
    """The counts of numbers that aren't missing."""
    return counts.where((F.col("mg_i") < len(numeric)) & F.col("mg_v").isNotNull() & ~F.isnan("mg_v"))


def contingency(df: DataFrame, numeric: list[str], categorical: list[str], y: str, q: int = 10, missing: str = "MISSING") -> DataFrame:
    """(feature, level, good, bad) of several features by one scan: numbers fall in their q-quantile bins, missing values are a level of their own."""
    counts = value_counts(df, numeric, categorical, y)
    edges = {}
    if numeric:
        counts = cut_lineage(counts)
        edges = {r["column_name"]: r["q"] for r in quantiles_in_long(_known(counts, numeric), numeric, [i / q for i in range(q + 1)], count="mg_k").collect()}
    return _cells(counts, numeric, categorical, edges, missing)


def _cells(counts: DataFrame, numeric: list[str], categorical: list[str], edges: dict[str, list[float]], missing: str = "MISSING") -> DataFrame:
    """(feature, level, good, bad) of `value_counts` and the quantiles of the numbers: bins meet counts, not rows."""
    level = F.col("level")
    if numeric:
        each = F.array(*(F.array(*map(F.lit, dict.fromkeys(edges.get(c, [])))).cast("array<double>") for c in numeric))
        level = F.coalesce(level, edge_bins(F.col("mg_v"), F.try_element_at(each, F.col("mg_i") + 1)).cast("string"))
    name = F.element_at(F.array(*map(F.lit, [*numeric, *categorical])), F.col("mg_i") + 1)
    of = lambda k: F.sum(F.when(F.col("mg_y") == k, F.col("mg_k")).otherwise(0)).cast("double")
    return counts.groupBy(name.alias("feature"), F.coalesce(level, F.lit(missing)).alias("level")).agg(of(0).alias("good"), of(1).alias("bad"))


def table_measures(cells: DataFrame) -> DataFrame:
    """feature, iv, chi2, dof, chi2_p, cramers_v and mutual_info of all contingency tables at once."""
    cells = cut_lineage(cells)
    total = cells.groupBy("feature").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"), F.count("*").alias("r"))
    n, t = F.col("good") + F.col("bad"), F.col("tg") + F.col("tb")
    floor = lambda a, b: F.greatest(F.try_divide(F.col(a), F.col(b)), F.lit(1e-6))
    part = lambda a, b: F.when((F.col(a) > 0) & (n > 0), F.col(a) / t * F.log(F.col(a) * t / (n * F.col(b)))).otherwise(0.0)

    def chi(a: str, b: str) -> Column:
        e = n * F.col(b) / t
        gap = F.abs(F.col(a) - e)
        gap = gap - F.when(F.col("r") == 2, F.least(F.lit(0.5), gap)).otherwise(0.0)
        return F.coalesce(F.try_divide(gap * gap, e), F.lit(0.0))

    each = cells.join(total, "feature").withColumns({"iv": (floor("good", "tg") - floor("bad", "tb")) * F.log(floor("good", "tg") / floor("bad", "tb")), "chi2": chi("good", "tg") + chi("bad", "tb"), "mi": part("good", "tg") + part("bad", "tb")})
    per = each.groupBy("feature", "r", "tg", "tb").agg(*(F.sum(c).alias(c) for c in ("iv", "chi2", "mi")))
    k = F.col("r").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / t - F.try_divide(k - 1, t - 1))
    low = F.coalesce(F.least(1 - F.try_divide(F.lit(1.0), t - 1), k - F.try_divide((k - 1) * (k - 1), t - 1) - 1), F.lit(0.0))
    dof = (F.col("r") - 1).cast("int")
    return per.select("feature", "iv", "chi2", dof.alias("dof"), chi2_p(F.col("chi2"), dof).alias("chi2_p"), F.when(low > 0, F.sqrt(phi / low)).otherwise(0.0).alias("cramers_v"), F.col("mi").alias("mutual_info"))


def association_table(df: DataFrame, numeric: list[str], categorical: list[str], y: str) -> DataFrame:
    """One row per feature: chi-square p, Cramer's V, information value and mutual information; for numbers also
    Mann-Whitney p and rank-biserial r; rounded to 4, sorted by information value.

    Numbers are cut into deciles for the table measures, with missing values as a level; for mutual information they
    are filled with the median. The rows are read once: every measure comes from the counts of (feature, value, outcome).
    """
    counts = cut_lineage(value_counts(df, numeric, categorical, y))
    known, edges, median = _known(counts, numeric), {}, {}
    if numeric:
        found = {r["column_name"]: r["q"] for r in quantiles_in_long(known, numeric, [*(i / 10 for i in range(11)), 0.5], count="mg_k").collect()}
        edges, median = {c: v[:-1] for c, v in found.items()}, {c: v[-1] for c, v in found.items()}
    out = table_measures(_cells(counts, numeric, categorical, edges)).withColumnRenamed("mutual_info", "mg_mi")
    if numeric:
        name = F.element_at(F.array(*map(F.lit, numeric)), F.col("mg_i") + 1).alias("feature")
        tested = _mann_whitneys(known.where("mg_y is not null").select("mg_i", "mg_v", F.col("mg_y").cast("long").alias("mg_y"), "mg_k"), numeric)
        out = out.join(tested.select("feature", F.col("p_value").alias("mwu_p"), "rank_biserial"), "feature", "left")
        middle = F.try_element_at(F.array(*(F.lit(median.get(c)).cast("double") for c in numeric)), F.col("mg_i") + 1)
        filled = _known(counts.where("mg_y is not null").withColumns({"mg_v": F.coalesce("mg_v", middle), "mg_y": F.col("mg_y").cast("int")}), numeric)
        filled = cut_lineage(filled.groupBy("mg_i", "mg_v", "mg_y").agg(F.sum("mg_k").alias("mg_c")))
        out = out.join(_mutual_informations_knn(filled).select(name, "mi"), "feature", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("mwu_p", "rank_biserial", "mi")})
    kind = F.when(F.col("feature").isin(numeric), "num").otherwise("cat")
    shown = {"chi2_p": F.col("chi2_p"), "cramers_v": F.col("cramers_v"), "mwu_p": F.col("mwu_p"), "rank_biserial": F.col("rank_biserial"), "iv": F.col("iv"), "mutual_info": F.coalesce("mi", "mg_mi")}
    return out.select("feature", kind.alias("type"), *(F.round(v, 4).alias(c) for c, v in shown.items())).orderBy(F.col("iv").desc(), "feature")


def importance_ranks(table: DataFrame, measures: list[str]) -> DataFrame:
    """Average-tie ranks, the largest first, cut to whole numbers as the report shows them; all measures are ranked together."""
    names = [f"rank_{c}" for c in measures]
    return with_ranks(table, measures, names, desc=True).withColumns({n: F.col(n).cast("int") for n in names})


def monotone(df: DataFrame, order: str, value: str) -> DataFrame:
    """Whether value never falls along order (few groups)."""
    d = df.withColumn("before", F.lag(value).over(W.orderBy(order)))
    return d.agg((F.count_if(F.col(value) < F.col("before")) == 0).cast("int").alias("is_monotone"))
