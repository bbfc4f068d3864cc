"""Streams of activities: daily load, stops as sessions and first-seen rows. The reference model is batch only; these go beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_load(events: DataFrame, value: str = "tss", late: str = "2 days") -> DataFrame:
    """Load by athlete and day; a day is final once the watermark has passed it."""
    return events.withWatermark("start_ts", late).groupBy("athlete_id", F.window("start_ts", "1 day")).agg(F.sum(value).alias("load"), F.count("*").alias("n")).select("athlete_id", F.col("window.start").cast("date").alias("day"), "load", "n")


def weekly_load(events: DataFrame, value: str = "tss", late: str = "2 days") -> DataFrame:
    """Seven days of load, sliding by a day."""
    return events.withWatermark("start_ts", late).groupBy("athlete_id", F.window("start_ts", "7 days", "1 day")).agg(F.sum(value).alias("load7")).select("athlete_id", F.date_sub(F.col("window.end").cast("date"), 1).alias("day"), "load7")


def sessions(samples: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Samples of an athlete that follow within ``gap`` of each other as one session."""
    return samples.withWatermark("start_ts", late).groupBy("athlete_id", F.session_window("start_ts", gap)).agg(F.count("*").alias("n")).select("athlete_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    return events.withWatermark("start_ts", late).dropDuplicatesWithinWatermark(["id"])
