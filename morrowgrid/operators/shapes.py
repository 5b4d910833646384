"""Reshaping: transposed tables, columns by type, rows by label, parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import r6
from .ranges import quantiles_of


def transpose(df: DataFrame, key: str, labels: list[str], name: str) -> DataFrame:
    """A small table with its columns as rows (`name`) and the given values of `key` as columns."""
    values = [c for c in df.columns if c != key]
    long = df.unpivot([key], values, name, "mg_value")
    return long.groupBy(name).agg(*(F.max(F.when(F.col(key) == v, F.col("mg_value"))).alias(v) for v in labels))


def numeric_only(df: DataFrame) -> DataFrame:
    """The columns whose type is a number."""
    return df.select(*(f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.NumericType)))


def column_medians(df: DataFrame) -> DataFrame:
    """(column_name, median) of all columns, in long form."""
    return quantiles_of(df, df.columns, [0.5]).select("column_name", r6(F.col("q")[0]).alias("median"))


def pick(df: DataFrame, key: str, labels: list) -> DataFrame:
    """The rows of the labels, with their position in the list; a label that isn't there gives a row of nulls."""
    order = df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(labels)], T.StructType([T.StructField("pos", T.IntegerType()), T.StructField(key, df.schema[key].dataType)]))
    return order.join(df, key, "left").orderBy("pos")


def grid(axes: dict[str, list], points: list[tuple] | None = None) -> list[tuple]:
    """The distinct points in order: those given, or the product of the axes."""
    if points is None:
        points = [()]
        for values in axes.values():
            points = [(*p, v) for p in points for v in sorted(set(values))]
    return sorted(set(points))
