"""Sources: Parquet tables, CSV files with declared schemas, and resolution of a local path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def resolve(spark: SparkSession, path: str) -> str:
    """The path, if Spark's file system has it."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return path


def fetch(spark: SparkSession, cached: str, sources: list[str]) -> str:
    """The cached copy of a data set; if there is none, the first source that exists is copied there.

    Any file system that Spark reads will do; a copy that breaks off leaves no cached file.
    """
    target, fs = _file(spark, cached)
    if fs.exists(target):
        return cached
    for source in sources:
        p, source_fs = _file(spark, source)
        if source_fs.exists(p):
            part, _ = _file(spark, cached + ".part")
            fs.delete(part, True)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, p, fs, part, False, True, conf)
            if not fs.rename(part, target):
                raise OSError(f"{cached} can't be written")
            return cached
    raise FileNotFoundError(f"none of {[cached, *sources]}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", timestamp_formats: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV file with header and declared schema. Text timestamps are parsed by the first format that fits; NaN becomes null."""
    formats = timestamp_formats or {}
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in formats else f.dataType, True) for f in schema.fields])
    df = spark.read.schema(raw).option("header", True).option("encoding", encoding).csv(resolve(spark, path))
    parsed = {c: F.coalesce(*(F.try_to_timestamp(F.col(c), F.lit(f)).cast("timestamp_ntz") for f in fs)) for c, fs in formats.items()}
    return nan_to_null(df.withColumns(parsed) if parsed else df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating-point column, so comparisons and groupings treat it as missing."""
    cols = {f.name: F.nanvl(F.col(f.name), F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(cols) if cols else df


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small relation of constants."""
    return spark.createDataFrame(rows, schema)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> None:
    """File sink: CSV parts with a header."""
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).option("timestampNTZFormat", timestamp_format).csv(path)


def as_lines(df: DataFrame, order: str, digits: int = 4) -> DataFrame:
    """Text sink: (no, line) with the columns of a small report table tabulated, a header first; `write.text` or show() puts them out."""
    shown = [F.format_string(f"%.{digits}f", F.col(f.name).cast("double")) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name).cast("string") for f in df.schema.fields]
    lines = df.select(F.row_number().over(W.orderBy(order)).alias("no"), F.concat_ws("\t", *(F.coalesce(c, F.lit("NaN")) for c in shown)).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "\t".join(df.columns))], "no int, line string")
    return head.unionByName(lines)


def plot_data(df: DataFrame, x: str, ys: list[str], kind: str = "line") -> DataFrame:
    """Plot sink: (kind, series, x, y) in long form, which any drawing tool takes; nothing is drawn here."""
    pairs = F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("y")) for c in ys))
    return df.select(F.col(x).alias("x"), F.explode(pairs).alias("s")).select(F.lit(kind).alias("kind"), "s.series", "x", "s.y")
