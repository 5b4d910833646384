"""Model search, comparison and calibration over all training rows: all candidates in all folds train in lockstep.

Features are encoded once on the training rows given (medians, levels, means and bins, none of which sees the label);
models see the rows of the other folds only. Oversampled rows are made from the rows of the other folds and seen by that fold's models only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import lockstep, trees
from .calibration import calibrated_scores, isotonic_blocks
from .features import levels_of, stratified_folds, stratified_split
from .lockstep import Logit
from .models import smote
from .ranges import cumulated, medians
from .trees import MADE, Boost

METRICS = ("roc_auc", "pr_auc", "f1", "recall", "brier")
#: The base models: level-wise and leaf-wise trees with one budget, and a logistic model.
BASE = {"logistic": Logit(), "level": Boost(trees=20, rate=0.3, depth=4, min_child=5.0, subsample=0.8, colsample=0.8), "leaf": Boost(trees=20, rate=0.3, depth=4, leaves=15, min_child=1e-3, min_rows=30, subsample=0.8, colsample=0.8)}
#: Trees of a point of `ranked` that doesn't say how many, and the range that a search draws them from (its end excluded).
SEARCH_TREES, TREES_FROM, TREES_TO = 8, 200, 800


@dataclass
class Wide:
    """Encoded features as plain numbers: imputed numbers, then levels as 0 and 1 (first one dropped)."""

    numeric: list[str]
    categorical: list[str]

    def fit(self, d: DataFrame) -> Wide:
        middle = medians(d, self.numeric)
        self.middle = {c: middle[c] if middle[c] is not None else 0.0 for c in self.numeric}
        self.levels = {c: levels_of(d, c)[1:] for c in self.categorical}
        self.names = [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c, vs in self.levels.items() for v in vs]
        self.cols = [f"x{i}" for i in range(len(self.names))]
        return self

    def table(self, d: DataFrame, key: str, fold) -> DataFrame:
        values = [F.coalesce(F.col(c).cast("double"), F.lit(self.middle[c])) for c in self.numeric]
        values += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in self.levels.items() for v in vs]
        return d.select(F.col(key).cast("long").alias("mg_key"), F.col("y").cast("int").alias("y"), fold.cast("int").alias("mg_fold"), *(v.alias(c) for v, c in zip(values, self.cols, strict=True)))


class Family:
    """What a kind of model needs of the rows: standardised features for logistic models, bins for trees."""

    def __init__(self, kind: str, wide: Wide, fitted_on: DataFrame):
        self.kind, self.wide, self.width = kind, wide, len(wide.cols)
        if kind == "logistic":
            s = fitted_on.agg(*(x for c in wide.cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s")))).first()
            self.scale = [(s[f"{c}_m"] or 0.0, s[f"{c}_s"] or 1.0) for c in wide.cols]
        else:
            self.binning = trees.Binning(wide.cols, []).fit(fitted_on)

    def rows(self, table: DataFrame) -> DataFrame:
        keep = ["mg_key", F.col("y").alias("mg_y"), "mg_fold"]
        if self.kind == "logistic":
            return cut_lineage(table.select(*keep, F.array(*((F.col(c) - m) / s for c, (m, s) in zip(self.wide.cols, self.scale, strict=True))).alias("mg_f")))
        return cut_lineage(self.binning.encode(table, keep))

    def fit(self, rows: DataFrame, jobs: list) -> list:
        return (lockstep if self.kind == "logistic" else trees).fit_models(rows, self.width, jobs)

    def predict(self, rows: DataFrame, models: list, held: list[int] | None = None) -> DataFrame:
        return (lockstep if self.kind == "logistic" else trees).predict(rows, self.width, models, held)


def encoded(d: DataFrame, key: str, enc: tuple[list[str], list[str]], folds: int) -> tuple[Wide, DataFrame]:
    """The encoder and the wide table with its folds, written once."""
    wide = Wide(*enc).fit(d)
    return wide, cut_lineage(wide.table(stratified_folds(d.select(key, "y", *enc[0], *enc[1]), key, "y", folds), key, F.col("fold")))


def metrics(scored: DataFrame) -> DataFrame:
    """(job and METRICS) of scores (job, mg_y, p): ties count half for the area, F1 and recall at 0.5; all jobs in one plan."""
    counts = cut_lineage(scored.groupBy(F.col("job").alias("mg_i"), F.col("p").alias("mg_v")).agg(F.count("*").alias("n"), F.sum(F.col("mg_y").cast("long")).alias("pos")))
    j = cumulated(counts, "n", more=["pos"]).withColumnsRenamed({"mg_upto": "n_upto", "mg_total": "n_all", "pos_upto": "p_upto", "pos_total": "p_all"})
    tp, above = F.col("p_all") - F.col("p_upto") + F.col("pos"), F.col("n_all") - F.col("n_upto") + F.col("n")
    p, n = F.col("p_all").cast("double"), F.col("n_all").cast("double")
    u = F.sum(F.col("pos") * (F.col("n_upto") - (F.col("n") - 1) / 2.0)) - F.first(p) * (F.first(p) + 1) / 2
    hit = F.col("mg_v") >= 0.5
    both, called = F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0))
    return j.groupBy(F.col("mg_i").alias("job")).agg(
        F.try_divide(u, F.first(p) * (F.first(n) - F.first(p))).alias("roc_auc"),
        F.sum(F.try_divide(F.col("pos").cast("double"), p) * tp / above).alias("pr_auc"),
        F.try_divide(2.0 * both, called + F.first(p)).alias("f1"),
        F.try_divide(both.cast("double"), F.first(p)).alias("recall"),
        (F.sum(F.col("pos") * (1 - F.col("mg_v")) ** 2 + (F.col("n") - F.col("pos")) * F.col("mg_v") ** 2) / F.first(n)).alias("brier"),
    )


def cross_validate(family: Family, rows: DataFrame, points: list, folds: int) -> DataFrame:
    """(point, fold and METRICS) of every point in every fold."""
    held = [f for _ in points for f in range(folds)]
    jobs = [replace(p, held=f) for p in points for f in range(folds)]
    scored = family.predict(rows.where(F.col("mg_fold") < MADE), family.fit(rows, jobs), held)
    return metrics(scored).select(F.floor(F.col("job") / folds).cast("int").alias("point"), (F.col("job") % folds).alias("fold"), *METRICS)


def positive_weight(table: DataFrame, ratio: float) -> float:
    """The weight of positive rows that brings the smaller class to `ratio` times the larger one."""
    n = {r.y: r["count"] for r in table.where(F.col("mg_fold") < MADE).groupBy("y").count().collect()}
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    return max(1.0, ratio * neg / pos) if pos <= neg else 1 / max(1.0, ratio * pos / neg)


def with_oversampled(wide: Wide, table: DataFrame, folds: int, k: int = 5, ratio: float = 1.0) -> DataFrame:
    """The table and, for each fold, the rows that oversampling makes of the other folds (as fold MADE + fold)."""
    out = table
    for f in range(folds):
        other = table.where(F.col("mg_fold") != f)
        made = smote(other, "mg_key", wide.cols, k, ratio).where("mg_key is null")
        number = F.lit(-1) - F.monotonically_increasing_id()
        out = out.unionByName(made.select(number.alias("mg_key"), "y", F.lit(MADE + f).alias("mg_fold"), *wide.cols))
    return cut_lineage(out)


def strategies(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kind: str, folds: int = 5) -> DataFrame:
    """No correction, class weights and oversampling under the same folds: mean of each metric."""
    wide, table = encoded(d, key, enc, folds)
    family = Family(kind, wide, table)
    rows = family.rows(with_oversampled(wide, table, folds))
    weight = positive_weight(table, 1.0)
    named = {"no_correction": {}, ("class_weight" if kind == "logistic" else "scale_pos_weight"): {"balanced": True} if kind == "logistic" else {"positive": weight}, "smote": {"made": True}}
    found = cross_validate(family, rows, [replace(BASE[kind], **p) for p in named.values()], folds)
    label = F.element_at(F.array(*map(F.lit, named)), F.col("point") + 1)
    return found.groupBy(label.alias("strategy")).agg(*(F.avg(m).alias(m) for m in METRICS))


def candidates(kind: str, n: int = 40, seed: int = 42) -> list[dict]:
    """Draws from the search spaces; ratio: how far class weights raise the smaller class."""
    rng = np.random.default_rng(seed)
    log = lambda a, b: float(np.exp(rng.uniform(np.log(a), np.log(b))))
    out = []
    for _ in range(n):
        p = {"ratio": float(rng.choice([0.4, 0.6, 0.8, 1.0]))}
        if kind == "logistic":
            p |= {"c": log(1e-4, 1e3), "l1": bool(rng.integers(0, 2))}
        else:
            p |= {"rate": log(0.05, 0.6), "subsample": float(rng.uniform(0.6, 1.0)), "colsample": float(rng.uniform(0.6, 1.0)), "lam": log(0.1, 30)}
            p |= {"depth": int(rng.integers(2, 5)), "min_child": float(rng.integers(1, 13)), "gamma": log(1e-3, 5)} if kind == "level" else {"leaves": int(rng.integers(4, 16)), "min_rows": int(rng.integers(10, 80))}
        out.append(p)
    return out


def budgeted(kind: str, n: int = 40, seed: int = 42) -> list[dict]:
    """The candidates of a search: for trees each with its own number of them."""
    drawn = candidates(kind, n, seed)
    if kind == "logistic":
        return drawn
    return [p | {"trees": int(t)} for p, t in zip(drawn, np.random.default_rng([seed, 1]).integers(TREES_FROM, TREES_TO, n), strict=True)]


#: The parameters that a refinement moves; the others keep the winner's values.
AXES = {"logistic": ("c", "ratio"), "level": ("rate", "min_child", "lam"), "leaf": ("rate", "min_rows", "lam")}


def refined(kind: str, drawn: list[dict], winner: int) -> list[dict]:
    """The winner and the points half way (in logarithms) to the next drawn value below and above it, on each axis."""
    grid = [drawn[winner]]
    for axis in AXES[kind]:
        here, others = drawn[winner][axis], sorted({p[axis] for p in drawn})
        beside = [max((v for v in others if v < here), default=here), min((v for v in others if v > here), default=here)]
        values = sorted({here, *(float(np.sqrt(here * v)) for v in beside)})
        grid = [g | {axis: v} for g in grid for v in values]
    return grid


def prepared(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kind: str, folds: int = 5) -> tuple[DataFrame, Family, DataFrame]:
    """What every stage of a search reads: the wide table, the fitted family and its rows, written once."""
    wide, table = encoded(d, key, enc, folds)
    family = Family(kind, wide, table)
    return table, family, family.rows(table)


def ranked(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kind: str, points: list[dict], folds: int = 5, ready: tuple | None = None) -> DataFrame:
    """(candidate, mean_auc, std_auc and the parameters) of every point; ready: what `prepared` gave for the same data."""
    table, family, rows = ready or prepared(d, key, enc, kind, folds)
    weight = {r: positive_weight(table, r) for r in {p["ratio"] for p in points}}
    size = {} if kind == "logistic" else {"trees": SEARCH_TREES}
    whole = lambda p: {k: int(round(v)) if k in ("min_rows", "leaves", "depth", "trees") else v for k, v in p.items() if k != "ratio"}
    found = cross_validate(family, rows, [replace(BASE[kind], **(size | whole(p)), positive=weight[p["ratio"]]) for p in points], folds)
    got = found.groupBy(F.col("point").alias("candidate")).agg(F.avg("roc_auc").alias("mean_auc"), F.stddev_pop("roc_auc").alias("std_auc"))
    names = sorted(points[0])
    listed = d.sparkSession.createDataFrame([(i, *(float(p[n]) for n in names)) for i, p in enumerate(points)], "candidate int, " + ", ".join(f"{n} double" for n in names))
    return got.join(F.broadcast(listed), "candidate")


def top(found: DataFrame, n: int = 5) -> DataFrame:
    """The n best, ties in the order drawn."""
    return found.orderBy(F.col("mean_auc").desc(), "candidate").limit(n)


def two_stage(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kind: str, n: int = 40, folds: int = 5) -> DataFrame:
    """The refinement around the best of n random candidates."""
    drawn = budgeted(kind, n)
    ready = prepared(d, key, enc, kind, folds)
    winner = top(ranked(d, key, enc, kind, drawn, folds, ready), 1).first()
    return ranked(d, key, enc, kind, refined(kind, drawn, winner["candidate"]), folds, ready)


def trained(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kind: str = "level", **params) -> tuple[Wide, Family, DataFrame, object]:
    """Encoder, family, the encoded rows of d and the base model trained on all of them."""
    wide, table = encoded(d, key, enc, 2)
    family = Family(kind, wide, table)
    rows = family.rows(table)
    return wide, family, rows, family.fit(rows, [replace(BASE[kind], **params)])[0]


def scores(fitted: tuple[Wide, Family, DataFrame, object], key: str) -> DataFrame:
    """(key, y, p) of the rows a model was trained on."""
    _, family, rows, model = fitted
    return family.predict(rows, [model]).select(F.col("mg_key").alias(key), F.col("mg_y").alias("y"), "p")


def calibrated(d: DataFrame, key: str, enc: tuple[list[str], list[str]], folds: int = 5, kind: str = "level") -> DataFrame:
    """Scores of all rows by `folds` pairs of model and isotonic map, averaged; each map is fitted on the fold its model hasn't seen."""
    wide, table = encoded(d, key, enc, folds)
    family = Family(kind, wide, table)
    rows = family.rows(table)
    models = family.fit(rows, [replace(BASE[kind], held=f) for f in range(folds)])
    every = cut_lineage(family.predict(rows, models).join(rows.select("mg_key", "mg_fold"), "mg_key"))
    parts = None
    for f in range(folds):
        own = every.where(F.col("job") == f)
        one = calibrated_scores(own, isotonic_blocks(own.where(F.col("mg_fold") == f), "p", "mg_y"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(F.col("mg_key").alias(key), F.col("mg_y").alias("y")).agg(F.avg("calibrated").alias("p"))


def model_table(d: DataFrame, key: str, enc: tuple[list[str], list[str]], kinds: tuple[str, ...] = ("logistic", "level", "leaf"), folds: int = 5) -> DataFrame:
    """Model families under one protocol: mean and spread of the folds' AUC on the training part, and metrics on the held-out fifth."""
    split = cut_lineage(stratified_split(d, key, "y"))
    wide, table = encoded(split.where("is_test = 0").drop("is_test"), key, enc, folds)
    test = wide.table(split.where("is_test = 1"), key, F.lit(-1))
    out = None
    for kind in kinds:
        family = Family(kind, wide, table)
        rows = family.rows(table)
        jobs = [replace(BASE[kind], held=f) for f in range(-1, folds)]
        models = family.fit(rows, jobs)
        cv = metrics(family.predict(rows, models[1:], list(range(folds)))).agg(F.avg("roc_auc").alias("cv_auc"), F.stddev_pop("roc_auc").alias("cv_std"))
        one = cv.crossJoin(metrics(family.predict(family.rows(test), models[:1]))).select(F.lit(kind).alias("model"), "cv_auc", "cv_std", *METRICS)
        out = one if out is None else out.unionByName(one)
    return out
