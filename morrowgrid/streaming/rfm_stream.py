"""Streaming profiles: windowed event counts with late data bounded by a watermark, and running user profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet event files in a folder as a stream, a file per trigger."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and value by window and type."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def user_profile(events: DataFrame) -> DataFrame:
    """Last event, count and value of each user, kept up to date."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("frequency"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("monetary"))


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Last event, count and value of each user by day, as a stream emits them once a day is over.

    The watermark bounds the state: a day's users are dropped when its end lies `late` behind the newest event.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    days = e.groupBy(F.window("ts", "1 day"), "user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return days.select(F.col("window.start").alias("day"), "user_id", "last", "n", "total")


def keep_daily(events: DataFrame, folder: str, checkpoint: str, late: str = "1 hour") -> int:
    """Drain what is there into a folder of closed days; how many rows came too late is returned.

    A batch overwrites the folder of its own number, so a batch that runs again after a failure isn't counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = daily(events, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(int(s["numRowsDroppedByWatermark"]) for p in q.recentProgress for s in p["stateOperators"])


def profiles_of_days(days: DataFrame) -> DataFrame:
    """The users' profiles from closed days."""
    return days.groupBy("user_id").agg(F.max("last").alias("last"), F.sum("n").alias("frequency"), F.sum("total").cast("double").alias("monetary"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain what is there into a memory table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
