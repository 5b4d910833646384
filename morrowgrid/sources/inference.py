"""Types of text columns, inferred from all their values by one aggregation.

The lattice, narrowest first: boolean, long, decimal, double, timestamp, text. A column gets the narrowest type that
takes all of its values; blanks and the marks of missing values take any type. A column without a value is text.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import nan_to_null, resolve

#: Marks of a missing value, and the timestamp forms that are tried in this order.
MISSING = ("", "NA", "N/A", "NULL", "null", "NaN", "nan")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")


def known(c: Column) -> Column:
    """The trimmed value, null if it is missing."""
    text = F.trim(c)
    return F.when(~text.isin(*MISSING), text)


def literals(form: str) -> list[str]:
    """Characters that every value of a timestamp form holds; none are named where the form has quotes, options or fractions."""
    return [] if set(form) & set("[]'{}#S") else sorted({x for x in form if x.isascii() and not x.isalnum()})


def as_timestamp(c: Column, formats: Sequence[str]) -> Column:
    """The first form that takes the value; a value without a form's own characters isn't parsed, as each failure is an exception."""

    def tried(form: str) -> Column:
        parsed, could = F.try_to_timestamp(c, F.lit(form)).cast("timestamp_ntz"), [c.contains(x) for x in literals(form)]
        return F.when(functools.reduce(Column.__and__, could), parsed) if could else parsed

    return F.coalesce(*map(tried, formats))


def inferred_schema(df: DataFrame, formats: Sequence[str] = FORMATS) -> T.StructType:
    """The narrowest type of each text column of df; one row of counts meets the driver."""

    def counts(c: Column) -> list[tuple[str, Column]]:
        v = known(c)
        whole, point = v.rlike(r"^[+-]?[0-9]+$"), v.rlike(r"^[+-]?[0-9]+[.][0-9]+$")
        digits = F.regexp_replace(F.regexp_extract(v, r"^[+-]?([0-9]+)", 1), "^0+(?=[0-9])", "")
        return [
            ("n", F.count(v)),
            ("boolean", F.count_if(F.lower(v).isin("true", "false"))),
            ("long", F.count_if(whole & v.try_cast("long").isNotNull())),
            ("number", F.count_if(whole | point)),
            ("left", F.max(F.when(whole | point, F.length(digits)))),
            ("right", F.max(F.when(point, F.length(F.substring_index(v, ".", -1))))),
            ("double", F.count_if(v.try_cast("double").isNotNull() & ~v.rlike("[dDfF]$"))),
            ("timestamp", F.count_if(as_timestamp(v, formats).isNotNull())),
        ]

    named = [(name, F.col(f"`{name}`")) for name in df.columns]
    one = df.agg(*(F.struct(*(x.alias(k) for k, x in counts(c))).alias(f"c{i}") for i, (_, c) in enumerate(named))).first()
    fields = []
    for i, (name, _) in enumerate(named):
        r = one[f"c{i}"]
        size, scale = (r["left"] or 0) + (r["right"] or 0), r["right"] or 0
        kinds = ((r["boolean"], T.BooleanType()), (r["long"], T.LongType()), (r["number"] if size <= 38 else -1, T.DecimalType(min(38, max(size, 1)), scale)), (r["double"], T.DoubleType()), (r["timestamp"], T.TimestampNTZType()))
        fields.append(T.StructField(name, next((t for n, t in kinds if r["n"] and n == r["n"]), T.StringType())))
    return T.StructType(fields)


def typed(df: DataFrame, schema: T.StructType, formats: Sequence[str] = FORMATS) -> DataFrame:
    """df's text columns as the types of the schema; missing values become null."""
    out = []
    for f in schema.fields:
        v = known(F.col(f"`{f.name}`"))
        out.append((as_timestamp(v, formats) if isinstance(f.dataType, T.TimestampNTZType) else v.cast(f.dataType)).alias(f.name))
    return nan_to_null(df.select(*out))


def read_csv_inferred(spark: SparkSession, path: str, encoding: str = "UTF-8", formats: Sequence[str] = FORMATS) -> DataFrame:
    """A CSV file with header whose types follow from all of its rows."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(resolve(spark, path))
    return typed(raw, inferred_schema(raw, formats), formats)
