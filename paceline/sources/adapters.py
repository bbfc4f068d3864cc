"""Activity-shaped views of general tables, so that every query runs on any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short activities within a month: one per event, athlete = user."""
    e = table(spark, sf_dir, "events")
    sport = F.when(F.col("event_type") == "click", "Run").when(F.col("event_type") == "view", "Ride").when(F.col("event_type") == "purchase", "Swim").when(F.col("event_type") == "signup", "TrailRun").otherwise("Workout")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("athlete_id"), F.col("ts").alias("start_ts"), F.col("ts").cast("date").alias("day"), sport.alias("sport_type"),
        (F.col("value") * 100.0).alias("distance"), (600 + F.col("event_id") % 60 * 60).alias("moving_time"), (660 + F.col("event_id") % 60 * 66).alias("elapsed_time"),
        F.when(F.col("event_id") % 5 != 0, (110 + F.col("event_id") % 80).cast("double")).alias("average_heartrate"),
        F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 200).cast("double")).alias("suffer_score"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("_p~iF"), F.col("event_id").cast("string"))).alias("polyline"),
    )


ACTIVITIES = """activity AS (
SELECT event_id AS id, user_id AS athlete_id, ts AS start_ts, CAST(ts AS DATE) AS day,
       CASE event_type WHEN 'click' THEN 'Run' WHEN 'view' THEN 'Ride' WHEN 'purchase' THEN 'Swim' WHEN 'signup' THEN 'TrailRun' ELSE 'Workout' END AS sport_type,
       value * CAST(100 AS DOUBLE) AS distance, 600 + event_id % 60 * 60 AS moving_time, 660 + event_id % 60 * 66 AS elapsed_time,
       CASE WHEN event_id % 5 <> 0 THEN CAST(110 + event_id % 80 AS DOUBLE) END AS average_heartrate,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 200 AS DOUBLE) END AS suffer_score, CASE WHEN event_id % 3 <> 0 THEN '_p~iF' || event_id END AS polyline
FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities over several years: one per order, athlete = customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("athlete_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("sport_type"),
        F.col("o_orderstatus").alias("workout_type"), (F.col("o_totalprice") / 10.0).alias("distance"), (1200 + F.col("o_orderkey") % 90 * 60).alias("moving_time"),
    )


HISTORY = """history AS (
SELECT o_orderkey AS id, o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS sport_type, o_orderstatus AS workout_type,
       o_totalprice / CAST(10 AS DOUBLE) AS distance, 1200 + o_orderkey % 90 * 60 AS moving_time FROM orders)"""


def gear_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of equipment: one per line, gear = part, distance in km = quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("gear_id"), F.col("l_suppkey").alias("athlete_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("km"),
        F.col("l_extendedprice").alias("effort"), F.col("l_discount").alias("grade"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
    )


GEAR_USES = """gear_use AS (
SELECT l_partkey AS gear_id, l_suppkey AS athlete_id, CAST(l_shipdate AS DATE) AS day, l_quantity AS km, l_extendedprice AS effort, l_discount AS grade,
       l_orderkey AS id, l_linenumber AS line FROM lineitem)"""


TRACK_SPORTS = ("Run", "TrailRun", "Ride", "GravelRide", "MountainBikeRide", "Hike", "Yoga")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user, a point per event in time order: idx from 0, seconds from the start, km covered, speed, grade, moving."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("activity_id"), (F.row_number().over(own) - 1).alias("idx"), F.col("ts"), (F.col("value") / 10.0).alias("speed"),
        (F.col("event_id") % 21 - 10).cast("double").alias("grade"), (F.col("event_id") % 7 != 0).alias("moving"),
        F.when(F.col("event_id") % 5 != 0, (110 + F.col("event_id") % 80).cast("double")).alias("heart_rate"), (F.col("event_id") % 300).cast("double").alias("power"),
        (F.col("event_id") % 13).cast("double").alias("step_m"), (F.col("event_id") % 10 * 1.0 + F.floor(F.col("value")) * 0.01).alias("elevation"),
        (F.col("event_id") * 37 % 360).cast("double").alias("bearing"), F.when(F.col("event_id") % 11 != 0, (60 + F.col("event_id") % 50).cast("double")).alias("cadence"),
        F.element_at(F.array(*map(F.lit, TRACK_SPORTS)), (F.col("user_id") % len(TRACK_SPORTS) + 1).cast("int")).alias("sport_type"),
    )


POINTS = """point AS (
SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, ts, value / CAST(10 AS DOUBLE) AS speed,
       CAST(event_id % 21 - 10 AS DOUBLE) AS grade, event_id % 7 <> 0 AS moving,
       CASE WHEN event_id % 5 <> 0 THEN CAST(110 + event_id % 80 AS DOUBLE) END AS heart_rate, CAST(event_id % 300 AS DOUBLE) AS power,
       CAST(event_id % 13 AS DOUBLE) AS step_m, event_id % 10 * CAST(1 AS DOUBLE) + floor(value) * CAST(0.01 AS DOUBLE) AS elevation,
       CAST(event_id * 37 % 360 AS DOUBLE) AS bearing, CASE WHEN event_id % 11 <> 0 THEN CAST(60 + event_id % 50 AS DOUBLE) END AS cadence,
       ['Run', 'TrailRun', 'Ride', 'GravelRide', 'MountainBikeRide', 'Hike', 'Yoga'][user_id % 7 + 1] AS sport_type FROM events)"""


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of twenty cells, with hours missing: one row per cell and hour in which other users than clickers were active."""
    e = table(spark, sf_dir, "events").where("event_type <> 'click'")
    codes = F.array(*map(F.lit, (0, 2, 45, 53, 61, 71, 82, 96, 4)))
    hours = e.groupBy((F.col("user_id") % 20).alias("cell"), F.date_trunc("hour", "ts").alias("ts")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    return hours.select(
        "cell", "ts", (F.col("a") % 35 - 5).cast("double").alias("temperature"), (F.col("b") % 7 * 0.5).alias("precipitation"), (F.col("a") % 40).cast("double").alias("wind_speed"), (F.col("b") % 8 * 45).alias("wind_direction"),
        (40 + F.col("a") % 60).cast("double").alias("humidity"), (980 + F.col("b") % 50).cast("double").alias("pressure"), F.get(codes, (F.col("a") % 9).cast("int")).alias("weather_code"),
    )


WEATHER = """weather_hourly AS (
SELECT cell, ts, CAST(a % 35 - 5 AS DOUBLE) AS temperature, b % 7 * CAST(0.5 AS DOUBLE) AS precipitation, CAST(a % 40 AS DOUBLE) AS wind_speed, b % 8 * 45 AS wind_direction, CAST(40 + a % 60 AS DOUBLE) AS humidity,
       CAST(980 + b % 50 AS DOUBLE) AS pressure, [0, 2, 45, 53, 61, 71, 82, 96, 4][a % 9 + 1] AS weather_code
FROM (SELECT user_id % 20 AS cell, date_trunc('hour', ts) AS ts, min(event_id) AS a, max(event_id) AS b FROM events WHERE event_type <> 'click' GROUP BY 1, 2))"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five heart rate zones of each customer; the last is open for every fourth."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("athlete_id"), F.posexplode(F.array(*map(F.lit, (110, 125, 140, 155, 170)))).alias("k", "lo"))
    high = F.when(F.col("k") < 4, F.col("lo") + 15).when(F.col("athlete_id") % 4 == 0, -1).otherwise(185 + F.col("athlete_id") % 10)
    return c.select("athlete_id", (F.col("k") + 1).alias("zone"), F.col("lo").cast("double").alias("min"), high.cast("double").alias("max"))


ZONES = """zones AS (
SELECT c_custkey AS athlete_id, k + 1 AS zone, CAST(110 + 15 * k AS DOUBLE) AS min, CAST(CASE WHEN k < 4 THEN 125 + 15 * k WHEN c_custkey % 4 = 0 THEN -1 ELSE 185 + c_custkey % 10 END AS DOUBLE) AS max
FROM customer, (SELECT CAST(range AS INTEGER) AS k FROM range(5)) z)"""


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laps of activities: one per line of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("activity_id"), F.col("l_linenumber").alias("lap"), (F.col("l_quantity") / 10.0).alias("km"), (300 + F.col("l_partkey") % 900).alias("seconds"),
        (110 + F.col("l_suppkey") % 70).cast("double").alias("heart_rate"), (F.col("l_partkey") % 400).alias("strokes"),
    )


LAPS = """laps AS (
SELECT l_orderkey AS activity_id, l_linenumber AS lap, l_quantity / CAST(10 AS DOUBLE) AS km, 300 + l_partkey % 900 AS seconds, CAST(110 + l_suppkey % 70 AS DOUBLE) AS heart_rate, l_partkey % 400 AS strokes FROM lineitem)"""


def hrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nightly heart-rate variability: a row for each user and day; one night in three was not measured, one weekly mean in four is missing."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("athlete_id"), F.to_date("ts").alias("day")).agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    low = 45.0 + F.col("athlete_id") % 10
    return days.select("athlete_id", "day", F.when(F.col("a") % 3 != 0, 35.0 + F.col("b") % 40).alias("nightly"), F.when(F.col("b") % 4 != 0, 40.0 + F.col("a") % 30).alias("avg7"), low.alias("reference_low"), (low + F.col("athlete_id") % 20).alias("reference_high"))


HRV = """hrv AS (
SELECT athlete_id, day, CASE WHEN a % 3 <> 0 THEN CAST(35 + b % 40 AS DOUBLE) END AS nightly, CASE WHEN b % 4 <> 0 THEN CAST(40 + a % 30 AS DOUBLE) END AS avg7, CAST(45 + athlete_id % 10 AS DOUBLE) AS reference_low,
       CAST(45 + athlete_id % 10 + athlete_id % 20 AS DOUBLE) AS reference_high FROM (SELECT user_id AS athlete_id, CAST(ts AS DATE) AS day, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1, 2))"""
