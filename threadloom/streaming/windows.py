"""Event-time operators: windows, sessions, late rows, and a stream joined to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a zoned timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total) of windows side by side."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    out = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    """(window_start, event_type, events) of overlapping windows."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    out = e.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "events")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with gaps below ``gap``."""
    e = timed(events)
    e = e.withWatermark("ts", late) if late else e
    out = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One row for each key within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream with a table's columns."""
    return events.join(table, key, "left")
