"""Event streams: windows, sessions and duplicates, the same plan in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory of Parquet files as a stream; times become timestamps, as watermarks need."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def late(events: DataFrame, delay: str) -> DataFrame:
    """A stream gets the watermark; a batch, where nothing is late, stays as it is."""
    return events.withWatermark("ts", delay) if events.isStreaming else events


def windows(events: DataFrame, length: str, delay: str = "10 minutes") -> DataFrame:
    """Per window and type: n, total value."""
    w = late(events, delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Per user and session (no pause of `gap`): start, end, n."""
    s = late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, keys: tuple[str, ...], delay: str = "10 minutes") -> DataFrame:
    """One event per key; a stream forgets keys behind the watermark."""
    return late(events, delay).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))
