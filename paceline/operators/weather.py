"""Weather of activities: the nearest hour, conditions in words, and summaries."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# General condition of each weather code.
GENERAL = {
    0: "Clear", 1: "Clear", 2: "Cloudy", 3: "Cloudy", 45: "Fog", 48: "Fog", 51: "Drizzle", 53: "Drizzle", 55: "Drizzle", 56: "Drizzle", 57: "Drizzle",
    61: "Rain", 63: "Rain", 65: "Rain", 66: "Rain", 67: "Rain", 71: "Snowfall", 73: "Snowfall", 75: "Snowfall", 77: "Snowfall", 80: "Rain", 81: "Rain", 82: "Rain",
    85: "Snowfall", 86: "Snowfall", 95: "Thunderstorm", 96: "Thunderstorm", 99: "Thunderstorm",
}


def condition(code: Column) -> Column:
    """The general condition of a weather code; other codes are named as unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain.from_iterable(GENERAL.items())])[code], F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def cell(lat: Column, lon: Column) -> Column:
    """Places that share an hourly forecast: both degrees to three decimals."""
    return F.concat_ws(":", *[F.round(x, 3).cast("decimal(9,3)").cast("string") for x in (lat, lon)])


def at_start(activities: DataFrame, hourly: DataFrame, keys: list[str], ts: str = "start_ts", seen: str = "ts") -> DataFrame:
    """``activities`` with ``weather``, the hourly row of the same key, day and hour; where that hour is missing, the day's row at
    the place of the hour's number, the last if there are fewer. A day's rows are at most 24, so they travel as one array."""
    fields = [c for c in hourly.columns if c not in keys]
    days = hourly.groupBy(*keys, F.to_date(seen).alias("_day")).agg(F.sort_array(F.collect_list(F.struct(seen, *[c for c in fields if c != seen]))).alias("_hours"))
    joined = activities.withColumn("_day", F.to_date(ts)).join(days, [*keys, "_day"], "left")
    same = F.filter("_hours", lambda h: F.hour(h[seen]) == F.hour(ts))
    other = F.get("_hours", F.least(F.hour(ts), F.size("_hours") - 1))
    return joined.withColumn("weather", F.coalesce(F.get(same, F.lit(0)), other)).drop("_day", "_hours")


def modal(value: Column) -> Column:
    """The most frequent value, the smallest among equals."""
    return F.mode(value, deterministic=True) if not isinstance(value, str) else F.mode(F.col(value), deterministic=True)
