"""Kinds of runs and rides by tables of rules, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import classify
from paceline.plans.base import number, query
from paceline.sources import adapters as A

FIVE = [(0.0, 130.0), (130.0, 145.0), (145.0, 160.0), (160.0, 175.0), (175.0, -1.0)]
FOUR = [(0.0, 130.0), (130.0, 145.0), (145.0, 160.0), (160.0, -1.0)]
NAMES = ["Morning run", "Tempo in the park", "Interval series", "Long run", "Easy spin", "Road race"]
OTHER_RUN = "CASE WHEN distance >= 12000 THEN 'Long Run' ELSE 'Easy/Recovery Run' END"


def _classes(rules, zones, fallback: str) -> str:
    """Tables ``act``, ``feat``, ``cls``: each track as an activity, its features, and its classes with their points by the table of rules."""
    names = sorted({c for group in rules for _, points in group for c in points})
    condition = lambda c: c.replace("name rlike '(?i)", "regexp_matches(lower(name), '") + ")" if "rlike" in c else c
    points = lambda n: " + ".join("CASE " + " ".join(f"WHEN {condition(c)} THEN {p.get(n, 0)}" for c, p in group) + " ELSE 0 END" for group in rules)
    zone = "CASE " + " ".join(f"WHEN heart_rate >= {a} AND ({b} = -1 OR heart_rate < {b}) THEN {k}" for k, (a, b) in enumerate(zones)) + " END"
    shares = (("low", "0, 1"), ("midhigh", "3"), ("high", "4")) if len(zones) == 5 else (("low", "0"), ("midhigh", "2"), ("high", "3"))
    within = "FILTER (p BETWEEN 2 AND 20)"
    return f"""{A.POINTS}, sp AS (SELECT activity_id, idx, heart_rate, CASE WHEN idx > 0 THEN 60 ELSE 0 END AS d_time, sum(step_m * 20 / 1000) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS km FROM point),
act AS (SELECT activity_id AS id, any_value(sport_type) AS sport_type, {NAMES}[activity_id % 6 + 1] AS name, CAST(activity_id % 4 AS INTEGER) AS workout_type, sum(step_m * 20) AS distance, (count(*) - 1) * 60 AS moving_time, count(*) * 66 AS elapsed_time, CAST(activity_id * 7 % 300 AS DOUBLE) AS suffer_score, avg(heart_rate) AS hr FROM point GROUP BY activity_id),
sw AS (SELECT *, km - lag(km) OVER (PARTITION BY activity_id ORDER BY idx) AS st, CASE WHEN d_time > 0 AND heart_rate > 0 THEN {zone} END AS zone, max(km) OVER (PARTITION BY activity_id) AS whole FROM sp), sv AS (SELECT *, CASE WHEN st > 0 AND d_time > 0 THEN d_time / CAST(60 AS DOUBLE) / st END AS p, CASE WHEN st > 0 AND d_time > 0 THEN st / d_time * 3600 END AS v FROM sw),
sf AS (SELECT activity_id AS id, CASE WHEN count(p) {within} >= 2 THEN stddev_pop(p) {within} / avg(p) {within} * 100 ELSE 0 END AS pace_cv, CASE WHEN count(v) >= 2 THEN stddev_pop(v) / avg(v) * 100 ELSE 0 END AS speed_cv, CASE WHEN count(*) > 10 AND count(heart_rate) >= 2 THEN stddev_pop(heart_rate) / avg(heart_rate) * 100 ELSE 0 END AS hr_cv,
  count(heart_rate) >= 30 AS has_hr, count(p) {within} >= 30 AS has_pace, CASE WHEN count(*) FILTER (idx = 0 AND km >= whole / 2) = 0 THEN min(idx * 60) FILTER (idx > 0 AND km >= whole / 2) END AS half, max(idx) * 60 AS total, {', '.join(f"coalesce(sum(d_time) FILTER (zone IN ({zs})) * CAST(100 AS DOUBLE) / nullif(sum(d_time) FILTER (zone IS NOT NULL), 0), 0) AS zone_{n}" for n, zs in shares)} FROM sv GROUP BY 1),
feat AS (SELECT act.*, sf.* EXCLUDE (id), has_hr AS has_zones, CASE WHEN half > 0 AND total > half THEN (total - half) / CAST(half AS DOUBLE) END AS second_half, distance / 1000 AS km, moving_time / CAST(60 AS DOUBLE) AS minutes, coalesce(moving_time / CAST(60 AS DOUBLE) / nullif(distance / 1000, 0), 0) AS pace, coalesce(distance / 1000 / nullif(moving_time / CAST(3600 AS DOUBLE), 0), 0) AS speed_kmh, least(1, moving_time / CAST(elapsed_time AS DOUBLE)) AS moving_ratio,
  least(300, suffer_score) / 300 AS effort, CAST(0 AS DOUBLE) AS climb_per_km FROM act LEFT JOIN sf ON sf.id = act.id),
c1 AS ({' UNION ALL '.join(f"SELECT id, distance, '{n}' AS class, {points(n)} AS points FROM feat" for n in names)}), c2 AS (SELECT * FROM c1 WHERE points > 0 UNION ALL SELECT id, distance, {fallback}, 100 FROM feat WHERE id NOT IN (SELECT id FROM c1 WHERE points > 0) AND {fallback} IS NOT NULL),
cls AS (SELECT id, class, points, row_number() OVER (PARTITION BY id ORDER BY points DESC, class) AS k, sum(points) OVER (PARTITION BY id) AS total FROM c2)"""


_CONFIDENCE = """t AS (SELECT id, max(points) FILTER (k = 1) AS p1, coalesce(max(points) FILTER (k = 2), 0) AS p2, sum(points) FILTER (k <= 5) AS five, any_value(total) AS total, max(class) FILTER (k = 1) AS class, count(*) AS n FROM cls GROUP BY 1),
v AS (SELECT feat.id, (CAST(km > 0 AS INTEGER) + CAST(minutes > 0 AS INTEGER) + 1 + CAST(pace > 0 AS INTEGER) + CAST(has_pace AS INTEGER) + CAST(effort > 0 AS INTEGER) + CAST(coalesce(hr > 0, false) AS INTEGER) + CAST(has_hr AS INTEGER) + CAST(has_zones AS INTEGER) + CAST(second_half IS NOT NULL AS INTEGER)) / CAST(10 AS DOUBLE) AS cover FROM feat),
s AS (SELECT v.id, class, n, p1, total, cover, least(CAST(0.99 AS DOUBLE), greatest(CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE) + coalesce((p1 - p2) / CAST(p1 AS DOUBLE), 0) * CAST(0.4 AS DOUBLE) + cover * CAST(0.3 AS DOUBLE) + coalesce(p1 / CAST(five AS DOUBLE), 0) * CAST(0.1 AS DOUBLE))) AS score FROM v LEFT JOIN t ON t.id = v.id)"""
_SCORED = f"SELECT id, class, CAST(p1 AS INTEGER) AS points, floor(p1 * CAST(1000 AS DOUBLE) / total + 0.5) / 10 AS share, CAST(coalesce(n, 0) AS INTEGER) AS n, {number('score', 2)} AS confidence, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS level, CAST({number('cover * 100', 0)} AS INTEGER) AS coverage FROM s"


def _tracks(spark, sf_dir):
    """Each track as an activity of a minute a sample, and its samples."""
    p = A.points(spark, sf_dir)
    w = Window.partitionBy("activity_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    samples = p.select("activity_id", "idx", "heart_rate", F.when(F.col("idx") > 0, 60).otherwise(0).alias("d_time"), F.sum(F.col("step_m") * 20 / 1000).over(w).alias("km"))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") % 6 + 1).cast("int"))
    acts = p.groupBy(F.col("activity_id").alias("id")).agg(F.max("sport_type").alias("sport_type"), F.sum(F.col("step_m") * 20).alias("distance"), ((F.count("*") - 1) * 60).alias("moving_time"), (F.count("*") * 66).alias("elapsed_time"), F.avg("heart_rate").alias("average_heartrate"))
    return acts.withColumns({"name": name, "workout_type": (F.col("id") % 4).cast("int"), "suffer_score": (F.col("id") * 7 % 300).cast("double")}), samples


def _told(df):
    first = F.get("classes", F.lit(0))
    return df.select("id", first["class"].alias("class"), first["points"].alias("points"), S.half_up(first["share"], 1).alias("share"), F.size("classes").alias("n"), F.col("confidence.score").alias("confidence"), F.col("confidence.level").alias("level"), F.col("confidence.coverage").alias("coverage"))


@query(f"WITH {_classes(classify.RUN, FIVE, OTHER_RUN)}, {_CONFIDENCE} {_SCORED}")
def run_types(spark, sf_dir):
    return _told(classify.classified(*_tracks(spark, sf_dir), classify.RUN, FIVE))


@query(f"WITH {_classes(classify.BIKE, FOUR, 'NULL')}, {_CONFIDENCE} {_SCORED}")
def bike_type_scores(spark, sf_dir):
    return _told(classify.classified(*_tracks(spark, sf_dir), classify.BIKE, FOUR))
