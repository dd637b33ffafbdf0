"""Windowed counts over an event stream. Beyond what the table operators need; the
same function serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value in tumbling windows by type; later events than
    ``late`` are left out of a stream (a batch has none)."""
    frame = events.withWatermark("ts", late) if events.isStreaming else events
    return frame.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    frame = events.withWatermark("ts", late) if events.isStreaming else events
    return frame.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
