"""Windowed aggregates that are the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions of users: (user_id, session_start, n); a pause of `gap` or more ends one."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def hourly(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
