"""Reports of a year, records, segments with all measures and loosely written days, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import annual
from paceline.operators import points as P
from paceline.plans.base import exact, number, query
from paceline.plans.tracks import STEPS
from paceline.sources import adapters as A

_SPORTS = ["Run", "Ride", "Swim", "WeightTraining", "Hike", "TrailRun"]
YEARS = f"""acts AS (SELECT id, athlete_id % 200 AS athlete_id, day, day + to_hours(id % 24) AS start_ts, {_SPORTS}[id % 6 + 1] AS sport_type, distance, moving_time, CAST(id % 500 AS DOUBLE) AS total_elevation_gain, CASE WHEN id % 4 <> 0 THEN CAST(id % 3 + 1 AS INTEGER) END AS athlete_count FROM history)"""


def _years(spark, sf_dir):
    h = A.history(spark, sf_dir)
    sport = F.element_at(F.array(*map(F.lit, _SPORTS)), (F.col("id") % 6 + 1).cast("int"))
    start = F.col("day").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))
    return h.select("id", (F.col("athlete_id") % 200).alias("athlete_id"), "day", start.alias("start_ts"), sport.alias("sport_type"), "distance", "moving_time", (F.col("id") % 500).cast("double").alias("total_elevation_gain"), F.when(F.col("id") % 4 != 0, (F.col("id") % 3 + 1).cast("int")).alias("athlete_count"))


_CAT = "CASE WHEN sport_type IN ('Run', 'TrailRun') THEN 'Run' WHEN sport_type = 'Ride' THEN 'Ride' WHEN sport_type = 'Swim' THEN 'Swim' WHEN sport_type = 'WeightTraining' THEN 'Gym' ELSE 'Other' END"
_MONTHS = ", ".join(f"coalesce({number(f'sum(h) FILTER (month(day) = {m})', 3)}, 0)" for m in range(1, 13))


@query(f"""WITH {A.HISTORY}, {YEARS}, a AS (SELECT *, {_CAT} AS cat, moving_time / CAST(3600 AS DOUBLE) AS h, year(day) = 1997 AS now FROM acts WHERE year(day) IN (1996, 1997)), n AS (SELECT * FROM a WHERE now),
t AS (SELECT athlete_id, count(*) FILTER (now) AS n, sum(distance) FILTER (now) AS d, sum(distance) FILTER (NOT now) AS d0, count(DISTINCT day) FILTER (now) AS active_days FROM a GROUP BY 1 HAVING count(*) FILTER (now) > 0),
p AS (SELECT athlete_id, coalesce(sum(h) FILTER (cat = 'Run'), 0) * 100 / nullif(sum(h), 0) AS run_share, [{_MONTHS}] AS months, {number("coalesce(sum(h) FILTER (hour(start_ts) BETWEEN 6 AND 11), 0)", 3)} AS morning, {number("coalesce(sum(h) FILTER (isodow(day) = 7), 0)", 3)} AS sunday, arg_max(id, (distance, -id)) AS longest, arg_max(id, (total_elevation_gain, -id)) AS climb,
  arg_min(id, (moving_time / (distance / 1000), id)) FILTER (cat = 'Run' AND distance >= 3000 AND moving_time > 0) AS fastest_run, arg_max(id, (distance, -id)) FILTER (cat = 'Swim') AS longest_swim, count(*) FILTER (athlete_count = 1) * CAST(100 AS DOUBLE) / nullif(count(athlete_count), 0) AS solo FROM n GROUP BY 1),
k AS (SELECT DISTINCT athlete_id, day FROM n), i AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS INTEGER) AS g FROM k), r AS (SELECT athlete_id, g, count(*) AS c, max(day) AS e FROM i GROUP BY 1, 2), s AS (SELECT athlete_id, max(c) AS longest_streak, coalesce(max(c) FILTER (e = DATE '1997-12-31'), 0) AS current_streak FROM r GROUP BY 1),
w AS (SELECT athlete_id, date_trunc('week', day)::DATE AS start, sum(distance) / 1000 AS km FROM n GROUP BY 1, 2), tw AS (SELECT athlete_id, arg_min(start, (-{number('km', 6)}, start)) AS top_week FROM w GROUP BY 1), mo AS (SELECT athlete_id, date_trunc('month', day)::DATE AS start, sum(distance) / 1000 AS km FROM n GROUP BY 1, 2), tm AS (SELECT athlete_id, arg_min(start, (-{number('km', 6)}, start)) AS top_month FROM mo GROUP BY 1),
y AS (SELECT athlete_id, sport_type, sum(h) AS h FROM n GROUP BY 1, 2), ys AS (SELECT athlete_id, array_to_string(list(sport_type ORDER BY {number('h', 6)} DESC, sport_type), ',') AS sports FROM y GROUP BY 1)
SELECT t.athlete_id, t.n, {number('d', 1)} AS distance, {number('(d - d0) * 100 / nullif(d0, 0)', 4)} AS distance_change, active_days, longest_streak, current_streak, top_week, top_month, {number('run_share', 3)} AS run_share, array_to_string(months, ',') AS months, morning, sunday, longest, climb, fastest_run, longest_swim, {number('solo', 3)} AS solo, sports
FROM t JOIN p ON p.athlete_id = t.athlete_id JOIN s ON s.athlete_id = t.athlete_id JOIN tw ON tw.athlete_id = t.athlete_id JOIN tm ON tm.athlete_id = t.athlete_id JOIN ys ON ys.athlete_id = t.athlete_id""")
def annual_report(spark, sf_dir):
    r = annual.annual_report(_years(spark, sf_dir), ["athlete_id"], 1997)
    return r.select(
        "athlete_id", "n", S.half_up(F.col("distance"), 1).alias("distance"), S.half_up(F.col("distance_change"), 4).alias("distance_change"), "active_days", "longest_streak", "current_streak", F.col("top_week.start").alias("top_week"), F.col("top_month.start").alias("top_month"), S.half_up(F.col("run_share"), 3).alias("run_share"),
        F.array_join(F.transform("month_hours", lambda h: S.half_up(h, 3).cast("string")), ",").alias("months"), S.half_up(F.col("part_hours.morning"), 3).alias("morning"), S.half_up(F.get("weekday_hours", F.lit(6)), 3).alias("sunday"), F.col("longest.id").alias("longest"), F.col("most_elevation.id").alias("climb"), F.col("fastest_run.id").alias("fastest_run"),
        F.col("longest_swim.id").alias("longest_swim"), S.half_up(F.col("solo_share"), 3).alias("solo"), F.array_join(F.transform("sports", lambda s: s["sport_type"]), ",").alias("sports"),
    )


@query(f"""WITH {A.HISTORY}, {YEARS}, v AS (SELECT *, distance / nullif(moving_time, 0) AS sp FROM acts), g AS (SELECT athlete_id, count(*) AS n, arg_max(id, (distance, -id)) AS longest, coalesce(arg_max(id, (sp, -id)) FILTER (distance > 1000 AND sp > 0), arg_max(id, (sp, -id)) FILTER (sp > 0)) AS fastest, arg_max(id, (total_elevation_gain, -id)) AS climb,
  date_diff('microsecond', min(start_ts), max(start_ts)) // 86400000000 AS span_days, avg(distance) / 1000 AS km, sum(CASE WHEN sp > 0 THEN 1000 / sp / 60 ELSE 0 END) / count(*) AS pace, count(*) FILTER (athlete_count = 1) * CAST(100 AS DOUBLE) / count(*) AS solo FROM v GROUP BY 1),
h AS (SELECT athlete_id, (hour(start_ts) + 22) % 24 AS hr, count(*) AS c FROM v GROUP BY 1, 2), fh AS (SELECT athlete_id, CAST(arg_min(hr, (-c, hr)) AS INTEGER) AS hour FROM h GROUP BY 1), w AS (SELECT athlete_id, isodow(day) - 1 AS d, count(*) AS c FROM v GROUP BY 1, 2), fw AS (SELECT athlete_id, CAST(arg_min(d, (-c, d)) AS INTEGER) AS weekday FROM w GROUP BY 1)
SELECT g.athlete_id, n, longest, fastest, climb, CAST(span_days AS BIGINT) AS span_days, {number('km', 4)} AS mean_km, {number('pace', 4)} AS mean_pace, {number('solo', 3)} AS solo, hour, weekday FROM g JOIN fh ON fh.athlete_id = g.athlete_id JOIN fw ON fw.athlete_id = g.athlete_id""")
def record_stats(spark, sf_dir):
    r = annual.record_stats(_years(spark, sf_dir), ["athlete_id"], hour_shift=-2)
    return r.select("athlete_id", "n", F.col("longest.id").alias("longest"), F.col("fastest.id").alias("fastest"), F.col("most_elevation.id").alias("climb"), "span_days", S.half_up(F.col("mean_km"), 4).alias("mean_km"), S.half_up(F.col("mean_pace"), 4).alias("mean_pace"), S.half_up(F.col("solo_share"), 3).alias("solo"), F.col("favourite_hour").alias("hour"), F.col("favourite_weekday").alias("weekday"))


def _segments(at: str, width: float, size: float, name: str, label: str) -> str:
    nz = lambda c: f"coalesce({exact(f'CASE WHEN {c} <> 0 THEN {c} END')}, 0)"
    return f"""WITH {A.POINTS}, {STEPS}, e AS (SELECT *, {at} AS m FROM k), f AS (SELECT *, CAST(floor(m / {width}) AS BIGINT) AS s, m = floor(m / {width}) * {width} AS edge, max(m) OVER (PARTITION BY activity_id) AS top FROM e), b AS (SELECT *, s AS segment FROM f WHERE s * {width} < top UNION ALL SELECT *, s - 1 FROM f WHERE edge AND s > 0),
g AS (SELECT activity_id, segment, count(*) AS n, CAST(min(idx) AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, arg_max(km, idx) - arg_min(km, idx) AS km, CAST(epoch_us(arg_max(ts, idx)) // 1000000 - epoch_us(arg_min(ts, idx)) // 1000000 AS BIGINT) AS seconds, arg_max(gain, idx) - arg_min(gain, idx) AS gain, {exact('speed')} AS avg_speed, max(speed) AS max_speed, {nz('heart_rate')} AS avg_hr,
  {nz('power')} AS avg_power, {nz('cadence')} AS avg_cadence, {exact('grade')} AS avg_grade, arg_min(CASE WHEN abs(grade) > 8 THEN 'technical' WHEN grade > 2 THEN 'climb' WHEN grade < -2 THEN 'descent' ELSE 'flat' END, idx) AS terrain FROM b GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT activity_id, segment, {label.format(x=f'segment * CAST({size} AS DOUBLE)')} || '-' || {label.format(x=f'(segment * CAST({size} AS DOUBLE) + {size})')} || ' {name}' AS name, n, start_idx, end_idx, {number('km', 5)} AS km, seconds, {number('gain', 3)} AS gain, {number('avg_speed', 4)} AS avg_speed, max_speed, {number('avg_hr', 4)} AS avg_hr, {number('avg_power', 4)} AS avg_power, {number('avg_cadence', 4)} AS avg_cadence,
  {number('avg_grade', 4)} AS avg_grade, terrain FROM g"""


def _told(s):
    digits = {"km": 5, "gain": 3, "avg_speed": 4, "avg_hr": 4, "avg_power": 4, "avg_cadence": 4, "avg_grade": 4}
    return s.select("activity_id", "segment", "name", "n", "start_idx", "end_idx", "km", "seconds", "gain", "avg_speed", "max_speed", "avg_hr", "avg_power", "avg_cadence", "avg_grade", "terrain").withColumns({c: S.half_up(F.col(c), d) for c, d in digits.items()})


@query(_segments(number("km * 1000", 3), 100.0, 0.1, "km", "printf('%.1f', {x})"))
def distance_segments(spark, sf_dir):
    return _told(P.segments(A.points(spark, sf_dir), "distance", 0.1))


@query(_segments("CAST(epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY activity_id) AS DOUBLE)", 86400.0 * 2, 2880.0, "min", "CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"))
def time_segments(spark, sf_dir):
    return _told(P.segments(A.points(spark, sf_dir), "time", 2880.0))


_ZONES = ", ".join(f"CAST(coalesce({number(f'count(*) FILTER ({c} > 0 AND {c} / CAST({w} AS DOUBLE) * 100 >= {a} AND {c} / CAST({w} AS DOUBLE) * 100 < {b}) / CAST(nullif(count(*) FILTER ({c} > 0), 0) AS DOUBLE) * 100', 0)}, 0) AS INTEGER) AS {n}_{k + 1}" for n, c, w, ends in (("hr", "heart_rate", 195, (0, 60, 70, 80, 90, 100000)), ("power", "power", 250, (0, 55, 75, 90, 105, 120, 100000))) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)))


@query(f"WITH {A.POINTS} SELECT activity_id, {_ZONES} FROM point GROUP BY 1")
def zone_percents(spark, sf_dir):
    return P.zone_percents(A.points(spark, sf_dir))


_SPELT = ["enero", "february", "märz", "avril", "maggio", "juin", "Juillet", "août", "settembre", "Oct.", "novembro", "dicembre"]


@query(f"""WITH d AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT id, day, make_date(1998, month(day), least(day(day), 28)) AS guess FROM d)
SELECT id, CASE id % 6 WHEN 4 THEN CASE WHEN month(day) = 3 THEN NULL WHEN guess - DATE '1998-06-30' > 30 THEN make_date(1997, month(day), least(day(day), 28)) ELSE guess END WHEN 5 THEN NULL WHEN 3 THEN CASE WHEN month(day) = 3 THEN NULL ELSE day END ELSE day END AS day FROM x""")
def loose_days(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    name, day = F.element_at(F.array(*map(F.lit, _SPELT)), F.month("d")), F.dayofmonth("d").cast("string")
    text = (
        F.when(F.col("id") % 6 == 0, F.date_format("d", "yyyy/M/d")).when(F.col("id") % 6 == 1, F.date_format("d", "d.M.yyyy")).when(F.col("id") % 6 == 2, F.date_format("d", "d-M-yyyy"))
        .when(F.col("id") % 6 == 3, F.concat(day, F.lit("  "), name, F.lit(" "), F.year("d").cast("string"))).when(F.col("id") % 6 == 4, F.concat(name, F.lit(" "), F.least(F.dayofmonth("d"), F.lit(28)).cast("string"))).otherwise(F.lit("soon"))
    )
    return o.select("id", S.loose_day(text, F.lit("1998-06-30").cast("date")).alias("day"))
