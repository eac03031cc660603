"""Event streams: windows with late data, repeated deliveries, and changes handed on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within the time that events may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; windows overlap if ``slide`` is shorter than ``width``."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each user: runs of events without a longer gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def hand_on(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Call a function with each batch of a stream."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
