"""Regularised logistic models in lockstep: one pass over all rows gives a round's sums for every model at once.

A model is a penalty (L1 or L2), its inverse strength, a class weighting and a fold it doesn't see. A round adds up, for
every model that hasn't converged, its loss, gradient and second derivatives over all rows; the driver solves the small
problems: a Newton step for L2, coordinate descent on the same quadratic for L1. A step that makes the objective worse
is halved and tried again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import seen, sigmoid

#: Rounds at most, and the largest move of a coefficient that counts as none.
ROUNDS, STILL = 60, 1e-7


@dataclass(frozen=True)
class Logit:
    """Minimise c * weighted loss + |b| (l1) or b.b / 2; the intercept isn't penalised. balanced: classes weigh alike; held, made: see `trees.seen`; positive: the weight of positive rows."""

    c: float = 1.0
    l1: bool = False
    balanced: bool = False
    held: int = -1
    made: bool = False
    positive: float = 1.0


def _solve(beta: np.ndarray, grad: np.ndarray, hess: np.ndarray, p: Logit) -> np.ndarray:
    """The next coefficients, the intercept last: the minimum of the quadratic about beta plus the penalty."""
    free = np.append(np.ones(len(beta) - 1), 0.0)
    if not p.l1:
        return beta - np.linalg.solve(p.c * hess + np.diag(free + 1e-10), p.c * grad + free * beta)
    a, b = p.c * hess + 1e-10 * np.eye(len(beta)), p.c * grad
    new, slope = beta.copy(), b.copy()  # slope: of the quadratic at new
    for _ in range(1000):
        moved = 0.0
        for j in range(len(new)):
            z = new[j] - slope[j] / a[j, j]
            to = np.sign(z) * max(abs(z) - free[j] / a[j, j], 0.0)
            if to != new[j]:
                slope += a[:, j] * (to - new[j])
                moved, new[j] = max(moved, abs(to - new[j])), to
        if moved < 1e-10:
            break
    return new


def fit_models(rows: DataFrame, width: int, jobs: list[Logit], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Coefficients of each job, the intercept last, from rows (mg_y int, mg_fold int, mg_f array<double>) with `width` features; a written table.

    What reaches the driver in a round is (width + 1) squared numbers for each model and partition of sums.
    """
    spark = rows.sparkSession
    d, parts = width + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    tally = {(r.mg_fold, r.mg_y): r.n for r in rows.groupBy("mg_fold", "mg_y").agg(F.count("*").alias("n")).collect()}
    weight = []
    for p in jobs:
        n = [sum(m for (fold, y), m in tally.items() if seen(fold, p.held, p.made) and y == k) for k in (0, 1)]
        weight.append([sum(n) / (2 * m) if p.balanced and m else k for m, k in zip(n, (1.0, p.positive), strict=True)])
    beta = [np.zeros(d) for _ in jobs]
    last: list[tuple[float, np.ndarray] | None] = [None] * len(jobs)
    live = list(range(len(jobs)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(({j: beta[j] for j in live}, weight))

        def sums(batches, shared=shared):
            coefficients, weights = shared.value
            total = {j: np.zeros(1 + d + d * d) for j in coefficients}
            for b in batches:
                y, fold = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mg_y", "mg_fold"))
                x = b.column("mg_f").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
                a = np.column_stack([x, np.ones(len(y))])
                for j, bj in coefficients.items():
                    w = np.where(seen(fold, jobs[j].held, jobs[j].made), np.where(y == 1, weights[j][1], weights[j][0]), 0.0)
                    z = a @ bj
                    q = sigmoid(z)
                    total[j][0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                    total[j][1 : 1 + d] += a.T @ (w * (q - y))
                    total[j][1 + d :] += ((a * (w * q * (1 - q))[:, None]).T @ a).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["job", "body"])

        def add(batches):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for j, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total[j] = total.get(j, 0.0) + np.frombuffer(body)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["job", "body"])

        got = {r.job: np.frombuffer(r.body) for r in rows.mapInArrow(sums, "job int, body binary").repartition(parts, "job").mapInArrow(add, "job int, body binary").collect()}
        going = []
        for j in live:
            p, s, bj = jobs[j], got[j], beta[j]
            size = np.abs(bj[:-1]).sum() if p.l1 else (bj[:-1] ** 2).sum() / 2
            objective = p.c * s[0] + size
            if last[j] is not None and objective > last[j][0] * (1 + 1e-12) + 1e-12 and np.abs(bj - last[j][1]).max() > STILL:
                beta[j] = (bj + last[j][1]) / 2
                going.append(j)
                continue
            new = _solve(bj, s[1 : 1 + d], s[1 + d :].reshape(d, d), p)
            last[j] = (objective, bj)
            beta[j] = new
            if np.abs(new - bj).max() > STILL:
                going.append(j)
        live = going
        if not live:
            break
    return beta


def predict(rows: DataFrame, width: int, betas: list[np.ndarray], held: list[int] | None = None) -> DataFrame:
    """(job, mg_key, mg_y, p) of every row by every model, or of the rows of the fold that the model hasn't seen."""
    shared = rows.sparkSession.sparkContext.broadcast(betas)

    def run(batches):
        for b in batches:
            fold = b.column("mg_fold").to_numpy(zero_copy_only=False)
            x = b.column("mg_f").flatten().to_numpy(zero_copy_only=False).reshape(len(fold), width)
            for j, beta in enumerate(shared.value):
                at = np.arange(len(x)) if held is None else np.flatnonzero(fold == held[j])
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j), pa.int32()), b.column("mg_key").take(take), b.column("mg_y").take(take), pa.array(sigmoid(x[at] @ beta[:-1] + beta[-1]), pa.float64())], names=["job", "mg_key", "mg_y", "p"])

    return rows.mapInArrow(run, "job int, mg_key long, mg_y int, p double")
