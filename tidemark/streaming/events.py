"""Event streams: windowed totals with late data, sessions, first facts, and rebuilding on new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """Parquet files of events as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_totals(events: DataFrame, length: str, late: str) -> DataFrame:
    """Counts and sums by event type in windows of a length; events later than the watermark are dropped, which batch never does."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    sums = timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Each user's sessions: runs of events with smaller gaps between them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def distinct_events(events: DataFrame, late: str) -> DataFrame:
    """Each event id once, however often its file is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Work off all files that are there, then stop; a later call goes on from the checkpoint. `write` gets each batch and its number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query
