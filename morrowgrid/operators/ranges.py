"""Orders over whole tables without a window over one partition: key ranges, positions, ranks and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: More ranges than this don't help: each is one window task's share.
MOST_RANGES = 1024
#: Cells of an octave in the first histogram of a selection, cells of a bucket in a later one, and rows of a bucket that are ordered at once.
OCTAVE_CELLS, BUCKET_CELLS, FEW = 256, 1 << 16, 1_000_000


def _count_below(col: Column, bounds: list) -> Column:
    """How many of the sorted bounds lie below a value, by bisection; 0 for null."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col <= F.lit(bounds[mid]), within(lo, mid)).otherwise(within(mid + 1, hi))

    return F.when(col.isNull(), 0).otherwise(within(0, len(bounds)))


def _bounds(df: DataFrame, col: str) -> list:
    """Approximate quantiles of a column on the driver, as many as there are shuffle partitions, at most MOST_RANGES; a hot value stands more than once."""
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    at = [i / n for i in range(1, n)]
    return sorted(df.agg(F.percentile_approx(col, at, max(1000, 10 * n)).alias("b")).first()["b"] or []) if at else []


def with_range(df: DataFrame, col: str, name: str = "part", desc: bool = False) -> DataFrame:
    """Add the number of the key range a value falls in, ascending along the order asked for.

    The boundaries are approximate quantiles brought to the driver (as many as
    there are shuffle partitions, at most MOST_RANGES), so every use of the result sees the same
    ranges, however its exchanges are planned. Equal values share a range.
    """
    bounds = sorted(set(_bounds(df, col)))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    below = _count_below(F.col(col), bounds)
    return df.withColumn(name, F.lit(len(bounds)) - below if desc else below)


def _before(sizes: DataFrame, by: Sequence[str], size: str, order: Sequence[str] = ("part",)) -> Column:
    """Sum over the earlier ranges (few rows: one a range and group)."""
    return F.coalesce(F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def numbered(values: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of any type with their number from 0 in order; the ranges are fixed by the write."""
    parts = cut_lineage(values.repartitionByRange(col).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("mg_size"))
    offsets = sizes.select("part", _before(sizes, [], "mg_size").alias("mg_off"))
    inner = F.row_number().over(W.partitionBy("part").orderBy(col))
    return parts.join(offsets, "part").withColumn(name, (F.col("mg_off") + inner - 1).cast("int")).drop("part", "mg_off")


def with_position(df: DataFrame, col: str, tie: str, by: Sequence[str] = (), name: str = "pos", desc: bool = False) -> DataFrame:
    """Add the position from 1 in the order of (col, tie), in each group of `by`; tie is a number.

    No task holds more than a range: a value that fills a range alone is a range of its own, cut further by the tie.
    """
    sign = -1 if desc else 1
    found = _bounds(df, col)
    bounds, hot = sorted(set(found)), sorted({b for b, c in zip(found, found[1:], strict=False) if b == c})
    below, alone = _count_below(F.col(col), bounds), F.coalesce(F.col(col).isin(hot), F.lit(False)) if hot else F.lit(False)
    within = _count_below(F.col(tie), sorted(set(_bounds(df.where(alone), tie)))) if hot else F.lit(0)
    parts = df.withColumns({"part": sign * (2 * below + alone.cast("int")), "mg_sub": F.when(alone, within).otherwise(0)})
    sizes = parts.groupBy(*by, "part", "mg_sub").agg(F.count("*").alias("mg_size"))
    offsets = sizes.select(*by, "part", "mg_sub", _before(sizes, by, "mg_size", ("part", "mg_sub")).alias("mg_off"))
    order = F.col(col).desc() if desc else F.col(col).asc()
    inner = F.row_number().over(W.partitionBy(*by, "part", "mg_sub").orderBy(order, tie))
    return parts.join(offsets, [*by, "part", "mg_sub"]).withColumn(name, (F.col("mg_off") + inner).cast("long")).drop("part", "mg_sub", "mg_off")


def in_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, mg_i, mg_v): the non-null values of several columns as doubles, by the column's number."""
    cells = F.array(*(F.struct(F.lit(i).alias("mg_i"), F.col(f"`{c}`").cast("double").alias("mg_v")) for i, c in enumerate(cols)))
    return df.select(*keep, F.explode(cells).alias("mg_s")).select(*keep, "mg_s.*").where(F.col("mg_v").isNotNull() & ~F.isnan("mg_v"))


def cumulated(rows: DataFrame, weight: str, tie: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """rows (mg_i, mg_v, ...) with mg_upto, the sum of weight up to each row in the order of (mg_v, tie) of its mg_i, and mg_total.

    All groups mg_i are ordered together: rows are dealt by range of (group, value) once, and summed on within each range; the
    ranges are fixed by the write, so all weights and all reads share them. more: further weights w, summed in the same
    pass as {w}_upto and {w}_total. rows must be a written table, since it is read twice; rows of one value meet in one task,
    so they are to be few: counts, not rows.
    """
    names = {weight: ("mg_upto", "mg_total")} | {w: (f"{w}_upto", f"{w}_total") for w in more}
    parts = cut_lineage(rows.repartitionByRange("mg_i", "mg_v").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("mg_i", "part").agg(*(F.sum(w).alias(f"mg_size_{w}") for w in names))
    off = [_before(sizes, ["mg_i"], f"mg_size_{w}").alias(f"mg_off_{w}") for w in names]
    total = [F.sum(f"mg_size_{w}").over(W.partitionBy("mg_i")).alias(t) for w, (_, t) in names.items()]
    within = W.partitionBy("mg_i", "part").orderBy("mg_v", *tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = parts.withColumns({u: F.sum(w).over(within) for w, (u, _) in names.items()})
    # as many rows as groups and ranges together: a range holds several groups or a piece of one
    joined = run.join(F.broadcast(sizes.select("mg_i", "part", *off, *total)), ["mg_i", "part"])
    return joined.withColumns({u: F.col(f"mg_off_{w}") + F.col(u) for w, (u, _) in names.items()}).drop("part", *(f"mg_off_{w}" for w in names))


def rank_tables(long: DataFrame, count: str | None = None) -> DataFrame:
    """(mg_i, mg_v, mg_n, mg_rank, mg_total) of the distinct values of (mg_i, mg_v): rows with the value, its average-tie rank from below, rows of the column.

    count: a column that tells how many rows a row of `long` stands for. All columns are ranked together, over their
    distinct values (see `cumulated`).
    """
    counts = cut_lineage(long.groupBy("mg_i", "mg_v").agg((F.sum(count) if count else F.count("*")).alias("mg_n")))
    return cumulated(counts, "mg_n").select("mg_i", "mg_v", "mg_n", (F.col("mg_upto") - (F.col("mg_n") - 1) / 2.0).alias("mg_rank"), "mg_total")


def with_ranks(df: DataFrame, cols: Sequence[str], names: Sequence[str], desc: bool = False) -> DataFrame:
    """Average-tie ranks of several columns, added under `names`; null and NaN stay null. The plan grows linearly in the columns."""
    d = cut_lineage(df.withColumn("mg_row", F.monotonically_increasing_id()))
    long = in_long(d, cols, ["mg_row"])
    rank = F.col("mg_total") + 1 - F.col("mg_rank") if desc else F.col("mg_rank")
    ranked = long.join(rank_tables(long).select("mg_i", "mg_v", rank.alias("mg_rank")), ["mg_i", "mg_v"])
    wide = ranked.groupBy("mg_row").agg(*(F.max(F.when(F.col("mg_i") == i, F.col("mg_rank"))).alias(n) for i, n in enumerate(names)))
    return d.drop(*names).join(wide, "mg_row", "left").drop("mg_row")


def _cell(v: Column) -> Column:
    """A number of few bits that grows with a double: its sign, its power of two and the cell of that octave it lies in."""
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    power = F.pow(F.lit(2.0), guess)
    e = F.when(a < power, guess - 1).when(a >= power * 2, guess + 1).otherwise(guess)
    place = F.floor((a / F.pow(F.lit(2.0), e) - 1) * OCTAVE_CELLS)
    size = F.when(a == 0, 0).when(a == F.lit(float("inf")), 1 << 30).otherwise((e + 1100) * OCTAVE_CELLS + place + 1)
    return (F.signum(v) * size).cast("int")


def quantiles_of(df: DataFrame, cols: Sequence[str], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, q): exact interpolated quantiles of several columns in each group; nulls and NaN aside.

    A column or group without a value has no row; rows with a null group are left out.
    """
    d = df
    for b in by:
        d = d.where(F.col(b).isNotNull())
    return quantiles_in_long(in_long(d, cols, by), cols, at, by)


def quantiles_in_long(long: DataFrame, cols: Sequence[str], at: Sequence[float], by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The same of a table (by, mg_i, mg_v) without nulls and NaN, by selection; count: a column that tells how many rows a row stands for.

    One pass counts the values of all columns and groups in the cells of a histogram whose cells are in the order of
    the values. Only the cells that hold a wanted position go on: they are cut into finer cells by further passes while
    they hold more than FEW rows and more than one value, and what is left of them is counted value by value.
    """
    key = [*by, "mg_i"]
    number = F.sum(count) if count else F.count("*")
    long = long.withColumn("mg_c", _cell(F.col("mg_v")))
    place = lambda p: F.lit(float(p)) * (F.col("mg_total") - 1)
    ranks = F.array_distinct(F.array(*(r(place(p)).cast("long") for p in at for r in (F.floor, F.ceil))))
    found: list[DataFrame] = []

    def wanted(hist: DataFrame, cells: Sequence[str], base: Column, total: Column) -> DataFrame:
        """The cells with wanted positions, of (key, cells, mg_n, lo, hi) in the order of `cells`; base: rows before the first."""
        w = W.partitionBy(*key, *cells[:-1]).orderBy(cells[-1])
        run = hist.withColumns({"mg_upto": base + F.sum("mg_n").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), "mg_total": total})
        inside = F.filter(ranks, lambda r: (r >= F.col("mg_upto") - F.col("mg_n")) & (r < F.col("mg_upto")))
        return cut_lineage(run.withColumn("mg_ranks", inside).where(F.size("mg_ranks") > 0).select(*key, "mg_c", "lo", "hi", "mg_n", (F.col("mg_upto") - F.col("mg_n")).alias("mg_before"), "mg_total", "mg_ranks"))

    ends = [number.alias("mg_n"), F.min("mg_v").alias("lo"), F.max("mg_v").alias("hi")]
    open_ = wanted(long.groupBy(*key, "mg_c").agg(*ends), ["mg_c"], F.lit(0), F.sum("mg_n").over(W.partitionBy(*key)))
    while True:
        found.append(open_.where("lo = hi").select(*key, "mg_total", F.explode("mg_ranks").alias("mg_r"), F.col("lo").alias("mg_v")))
        most = open_.where("lo < hi").agg(F.max("mg_n").alias("n")).first()["n"]
        if not most:
            break
        cells = open_.where("lo < hi").drop("mg_n")
        rows = long.join(cells, [*key, "mg_c"]).where("mg_v >= lo and mg_v <= hi")
        if most <= FEW:
            values = rows.groupBy(*key, "mg_c", "lo", "mg_before", "mg_total", "mg_ranks", "mg_v").agg(number.alias("mg_n"))
            upto = F.col("mg_before") + F.sum("mg_n").over(W.partitionBy(*key, "mg_c", "lo").orderBy("mg_v").rowsBetween(W.unboundedPreceding, W.currentRow))
            here = values.withColumn("mg_upto", upto).withColumn("mg_r", F.explode(F.filter("mg_ranks", lambda r: (r >= F.col("mg_upto") - F.col("mg_n")) & (r < F.col("mg_upto")))))
            found.append(here.select(*key, "mg_total", "mg_r", "mg_v"))
            break
        # halves before the difference, so that it stays finite; a product of increasing steps keeps the order
        finer = F.floor((F.col("mg_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKET_CELLS).cast("int")
        kept = rows.select(*key, "mg_c", F.col("lo").alias("mg_lo"), "mg_before", F.col("mg_total").alias("mg_t"), "mg_v", finer.alias("mg_f"), *([count] if count else []))
        hist = kept.groupBy(*key, "mg_c", "mg_lo", "mg_before", "mg_t", "mg_f")
        open_ = wanted(hist.agg(*ends), ["mg_c", "mg_lo", "mg_f"], F.col("mg_before"), F.col("mg_t"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = every.groupBy(*key, "mg_total").agg(F.map_from_entries(F.collect_set(F.struct("mg_r", "mg_v"))).alias("mg_m"))  # two entries a quantile at most
    value = lambda x: F.try_element_at("mg_m", x.cast("long"))
    between = [(1 - (place(p) - F.floor(place(p)))) * value(F.floor(place(p))) + (place(p) - F.floor(place(p))) * value(F.ceil(place(p))) for p in at]
    name = F.element_at(F.array(*map(F.lit, cols)), F.col("mg_i") + 1)
    return one.select(*by, name.alias("column_name"), F.array(*between).alias("q"))


def quantiles(df: DataFrame, col: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q): exact interpolated quantiles of a column in each group (see `quantiles_of`); without groups, one row even if there is no value."""
    kept = [(b, f"mg_by{i}") for i, b in enumerate(by)]
    one = quantiles_of(df.select(*(F.col(b).alias(n) for b, n in kept), F.col(col).alias("mg_value")), ["mg_value"], at, [n for _, n in kept])
    if not by:
        return one.agg(F.coalesce(F.first("q"), F.array(*[F.lit(None).cast("double")] * len(at))).alias("q"))
    return one.select(*(F.col(n).alias(b) for b, n in kept), "q")


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """The exact median of each column (a row each meets the driver)."""
    found = {r["column_name"]: r["q"][0] for r in quantiles_of(df, cols, [0.5]).collect()}
    return {c: found.get(c) for c in cols}
