"""Streams over the events table: an extension, the batch engine has none.

State is bounded by watermarks; late rows beyond them are dropped by Spark as asked for by the caller's delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files in the folder; ts is an instant in the session's time zone."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows, sliding with `slide`."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n)."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a finite stream into an in-memory table; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
