"""Streams that built-in operators express (T1, T6, T7): windows, sessions, deduplication.

Rows behind the watermark are dropped; a window leaves when the watermark passes its end. To count and keep late
rows, let these streams read what ``late.admit`` accepted: they drop nothing then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def conversation_sessions(
    events: DataFrame, key: str = "user_id", idle: str = "30 minutes", watermark: str = WATERMARK
) -> DataFrame:
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", idle).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("s.start").alias("started_at"), F.col("s.end").alias("ends_at"), "n_events")
    )


def windowed_kpis(
    events: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Counts and error rate per tumbling or sliding window."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    n = F.count(F.lit(1))
    return (
        events.withWatermark("ts", watermark)
        .groupBy(window.alias("w"))
        .agg(
            n.alias("n_events"), F.count_if("is_error").alias("n_errors"),
            (F.count_if("is_error") / n).alias("error_rate"), F.max("response_s").alias("max_response_s"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "n_errors",
                "error_rate", "max_response_s")
    )


def dedupe_updates(updates: DataFrame, key: str = "update_id", watermark: str = WATERMARK) -> DataFrame:
    """A re-delivered update counts once."""
    return updates.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
