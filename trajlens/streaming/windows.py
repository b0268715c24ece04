"""Event-time windows, the same for batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), *keys).agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), *keys, "events", "total")


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), *keys, "events")


def activity(events: DataFrame, gap: str, key: str) -> DataFrame:
    """Stretches of activity with no pause of ``gap`` or more."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
