"""Isotonic regression over all rows by merging blocks.

Rows are counted by distinct score first. Scores are cut into ranges; in each range neighbouring scores whose means fall
are pooled into blocks. Then neighbouring ranges are merged two by two, in turns: the blocks of two ranges are pooled
again, and a block that reaches over the border goes to the lower range. This ends when no border has a fall. A task holds the blocks
of two ranges at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranges import with_range

_BLOCK = "mg_g long, lo double, hi double, s double, n long"


def _pool(b: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators among blocks in the order of their scores; equal means are one block."""
    out: list[list] = []
    for g, lo, hi, s, n in b.sort_values("lo")[["mg_g", "lo", "hi", "s", "n"]].itertuples(index=False):
        out.append([g, lo, hi, s, n])
        while len(out) > 1 and out[-2][3] * out[-1][4] >= out[-1][3] * out[-2][4]:
            _, _, hi, s, n = out.pop()
            out[-1][2:] = [hi, out[-1][3] + s, out[-1][4] + n]
    return pd.DataFrame(out, columns=["mg_g", "lo", "hi", "s", "n"])


def isotonic_blocks(s: DataFrame, score: str = "p", target: str = "y") -> DataFrame:
    """(lo, hi, value, n): the least-squares non-decreasing step map from score to target (0 or 1); rows without one of them are left out."""
    rows = s.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    counts = cut_lineage(rows.groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(F.col(target).cast("long")).cast("double").alias("s"), F.count("*").alias("n")))
    first = with_range(counts, "lo").select(F.col("part").cast("long").alias("mg_g"), "lo", F.col("lo").alias("hi"), "s", "n")
    blocks = cut_lineage(first.groupBy("mg_g").applyInPandas(_pool, _BLOCK))
    while True:
        # the ranges that still have blocks, numbered without gaps (few rows: one a range)
        ends = blocks.groupBy("mg_g").agg(F.min_by(F.col("s") / F.col("n"), "lo").alias("first"), F.max_by(F.col("s") / F.col("n"), "lo").alias("last"))
        order = W.orderBy("mg_g")
        border = ends.select("mg_g", (F.row_number().over(order) - 1).cast("long").alias("rank"), (F.lag("last").over(order) >= F.col("first")).alias("falls"))
        falls = sorted(r["rank"] for r in border.where("falls").select("rank").collect())
        if not falls:
            break
        # pairs of ranges that begin at an odd or an even number, whichever has more falls to mend
        odd = 2 * sum((r - 1) % 2 for r in falls) > len(falls)
        pair = F.floor((F.col("rank") + (1 if odd else 0)) / 2)
        numbered = blocks.join(border.select("mg_g", "rank"), "mg_g").select(F.col("rank").alias("mg_g"), "lo", "hi", "s", "n", pair.alias("mg_pair"))
        blocks = cut_lineage(numbered.groupBy("mg_pair").applyInPandas(lambda b: _pool(b), _BLOCK))
    return blocks.select("lo", "hi", (F.col("s") / F.col("n")).alias("value"), "n")


def calibrated_scores(s: DataFrame, blocks: DataFrame, score: str = "p", name: str = "calibrated") -> DataFrame:
    """s with the value of the block that a score falls in; between two blocks the line that joins them, beyond the outermost their value.

    The blocks meet the rows as ranges of a broadcast map only if Spark finds them small; they are looked up by a sorted merge of both.
    """
    points = blocks.select(F.col("lo").alias("mg_x"), F.lit(0).alias("mg_o"), F.struct("lo", "hi", "value").alias("mg_b"))
    wanted = s.select(F.col(score).cast("double").alias("mg_x")).where("mg_x is not null").distinct()
    both = cut_lineage(points.unionByName(wanted.select("mg_x", F.lit(1).alias("mg_o"), F.lit(None).cast("struct<lo:double,hi:double,value:double>").alias("mg_b"))))
    parts = with_range(both, "mg_x")
    # the last block before a range and the first one after it (few rows)
    ends = parts.groupBy("part").agg(F.max_by("mg_b", F.when(F.col("mg_b").isNotNull(), F.col("mg_x"))).alias("z"), F.min_by("mg_b", F.when(F.col("mg_b").isNotNull(), F.col("mg_x"))).alias("a"))
    w = W.orderBy("part")
    around = ends.select("part", F.last("z", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("a", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    own = W.partitionBy("part").orderBy("mg_x", "mg_o")
    left = F.coalesce(F.last("mg_b", ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)), F.col("before"))
    right = F.coalesce(F.first("mg_b", ignorenulls=True).over(own.rowsBetween(1, W.unboundedFollowing)), F.col("after"))
    placed = parts.join(around, "part").withColumns({"l": left, "r": right}).where("mg_o = 1")
    slope = (F.col("mg_x") - F.col("l.hi")) / (F.col("r.lo") - F.col("l.hi"))
    value = F.when(F.col("l").isNull(), F.col("r.value")).when((F.col("mg_x") <= F.col("l.hi")) | F.col("r").isNull(), F.col("l.value")).otherwise(F.col("l.value") + slope * (F.col("r.value") - F.col("l.value")))
    found = placed.select("mg_x", value.alias(name))
    return s.join(found, F.col(score).cast("double") == F.col("mg_x"), "left").drop("mg_x")
