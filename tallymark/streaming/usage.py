"""Counters, limits and sessions, each over a batch or a stream of (ts, user_id, name) rows. Watermarks are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def daily_counts(rows: DataFrame, late: str = "1 day") -> DataFrame:
    w = F.window("ts", "1 day")
    return _marked(rows, late).where("name <> ''").groupBy(w, "name").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "name", "n")


def over_limit(rows: DataFrame, width: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Fixed windows in which a user exceeds the limit."""
    counted = _marked(rows, late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("window.start").alias("window_start"), "user_id", "n")


def sessions(rows: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's rows with less than `gap` between neighbours."""
    return _marked(rows, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select("user_id", F.col("w.start").alias("first_ts"), "last_ts", "n")
