"""Readers of activity histories, streams and recovery exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalars import folded, loose_number, loose_range

LAP = "struct<distance:double,moving_time:bigint,average_speed:double,average_heartrate:double>"
ACTIVITY_DDL = (
    "id bigint, athlete struct<id:bigint>, name string, type string, sport_type string, start_date timestamp, start_date_local timestamp_ntz, distance double, moving_time bigint, elapsed_time bigint, "
    "total_elevation_gain double, average_speed double, max_speed double, average_heartrate double, max_heartrate double, average_cadence double, average_watts double, weighted_average_watts double, "
    "ftp double, suffer_score double, gear_id string, workout_type int, athlete_count int, trainer boolean, tags array<string>, start_latlng array<double>, map struct<summary_polyline:string>, "
    f"laps array<{LAP}>, splits_metric array<{LAP}>, _corrupt_record string"
)


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Pages of activities as JSON (an array or a row a line); malformed rows keep their text in ``_corrupt_record``."""
    raw = spark.read.schema(ACTIVITY_DDL).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.withColumns({"athlete_id": F.col("athlete.id"), "sport_type": F.coalesce("sport_type", "type"), "day": F.to_date("start_date_local"), "summary_polyline": F.col("map.summary_polyline")}).drop("athlete", "map")


def streams(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Sensor streams from Parquet, only the arrays asked for."""
    return spark.read.parquet(path).select("activity_id", *keys)


def stream_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select("activity_id", *[F.coalesce(F.size(k), F.lit(0)).alias(k) for k in keys])


def athletes(spark: SparkSession, path: str) -> DataFrame:
    """Athlete profiles, a JSON document each; documents without an id (failed requests) are left out."""
    ddl = "id bigint, firstname string, lastname string, sex string, city string, country string, weight double, ftp double"
    return spark.read.schema(ddl).option("multiLine", "true").json(path).where("id is not null")


def gears(spark: SparkSession, path: str) -> DataFrame:
    """Equipment, a JSON document an item under ``path``, all read at once; failed items, which have no id, are left out."""
    ddl = "id string, name string, brand_name string, model_name string, primary boolean, retired boolean, distance double"
    return spark.read.schema(ddl).option("multiLine", "true").json(path).where("id is not null")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """``kind, zone, low, high`` from zone documents: zones count from 1, an open upper end (-1) is null."""
    one = "struct<custom_zones:boolean,zones:array<struct<min:double,max:double>>>"
    raw = spark.read.schema(f"heart_rate {one}, power {one}").option("multiLine", "true").json(path)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.zones").alias("zones")) for k in ("heart_rate", "power")])
    rows = raw.select(F.inline(kinds)).select("kind", F.posexplode("zones").alias("at", "z"))
    return rows.select("kind", (F.col("at") + 1).alias("zone"), F.col("z.min").alias("low"), F.when(F.col("z.max") >= 0, F.col("z.max")).alias("high"))


def hourly_weather(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """``latitude, longitude, ts`` and ``fields``, a row an hour, from documents that hold an array for each field; documents
    without hours (failed requests) give no rows, and an array that is too short ends in nulls."""
    hourly = ",".join(["time:array<string>", *[f"`{f}`:array<double>" for f in fields]])
    raw = spark.read.schema(f"latitude double, longitude double, hourly struct<{hourly}>").option("multiLine", "true").json(path)
    rows = raw.select("latitude", "longitude", F.inline(F.arrays_zip(*[F.col(f"hourly.`{c}`").alias(c) for c in ("time", *fields)])))
    return rows.withColumn("ts", F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm"))).where("ts is not null").select("latitude", "longitude", "ts", *fields)


def snapshot(spark: SparkSession, path: str, version: str, newest: str, max_hours: float) -> DataFrame:
    """Rows of a versioned snapshot that are young enough at the moment ``newest``."""
    age = (F.unix_timestamp(F.lit(newest).cast("timestamp")) - F.unix_timestamp("ingested_at")) / 3600.0
    return spark.read.parquet(path).where((F.col("version") == version) & (age <= max_hours))


# What the columns of a recovery export may be called, folded to plain lower case.
HEADERS = {
    "day": ["date", "fecha", "data", "day", "dia"], "nightly": ["overnight hrv", "nightly", "vfc nocturna", "hrv", "last night"], "range": ["baseline", "range", "rango", "referencia", "intervalo"],
    "avg7": ["7d avg", "7 day avg", "7d average", "media 7d", "promedio 7d", "weekly avg"],
}


def parsed_day(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in ("yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "MMM d, yyyy")])


def recovery_csv(spark: SparkSession, path: str) -> DataFrame:
    """``day, nightly, ref_low, ref_high, avg7`` from an export with comma, semicolon or tab; the last row of a day counts."""
    first = spark.read.text(path).limit(1).first()
    head = (first[0] if first else "").lstrip("﻿")
    sep = max(",;\t", key=head.count)
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    plain = {c: spark.range(1).select(folded(F.lit(c))).first()[0] for c in raw.columns}

    def named(kind: str) -> Column:
        return next((F.col(f"`{c}`") for c, p in plain.items() if any(p == h for h in HEADERS[kind])), next((F.col(f"`{c}`") for c, p in plain.items() if any(h in p for h in HEADERS[kind])), F.lit(None).cast("string")))

    bounds = loose_range(named("range"))
    rows = raw.select(parsed_day(named("day")).alias("day"), loose_number(named("nightly")).alias("nightly"), bounds["low"].alias("ref_low"), bounds["high"].alias("ref_high"), loose_number(named("avg7")).alias("avg7"), F.monotonically_increasing_id().alias("_k"))
    return rows.where("day is not null").groupBy("day").agg(*[F.max_by(c, "_k").alias(c) for c in ("nightly", "ref_low", "ref_high", "avg7")])


def synthetic(spark: SparkSession, n: int = 500, span_days: int = 730, seed: int = 7, end: str = "2024-12-31") -> DataFrame:
    """A seeded history of activities with plausible measures."""
    sports = ["Run", "Ride", "Swim", "TrailRun", "Workout"]
    base = spark.range(n).withColumns({"u": F.rand(seed), "v": F.randn(seed + 1), "w": F.rand(seed + 2)})
    sport = F.element_at(F.array(*map(F.lit, sports)), (F.floor(F.col("u") * 5) + 1).cast("int"))
    day = F.date_sub(F.lit(end).cast("date"), F.floor(F.col("w") * span_days).cast("int"))
    km = F.least(F.greatest(10 + 4 * F.col("v"), F.lit(2.0)), F.lit(42.0))
    return base.select("id", F.lit(1).cast("long").alias("athlete_id"), day.alias("day"), sport.alias("sport_type"), (km * 1000).alias("distance"), F.floor(km * 330).cast("long").alias("moving_time"), F.floor(km * 350).cast("long").alias("elapsed_time"), F.floor(140 + 10 * F.col("v")).cast("double").alias("average_heartrate"))
