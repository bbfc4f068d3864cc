"""Queries on athletes and their equipment, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import aggregates as G
from paceline.operators import analysers, enrich
from paceline.operators import cards as C
from paceline.operators import points as P
from paceline.operators import reports as R
from paceline.plans.base import number, query
from paceline.plans.tracks import STEPS
from paceline.sources import adapters as A


@query(f"""WITH {A.GEAR_USES}, d AS (SELECT athlete_id % 20 AS athlete_id, day, sum(km) AS total FROM gear_use GROUP BY 1, 2), o AS (SELECT *, CAST(floor(total) AS BIGINT) AS u, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k, count(*) OVER (PARTITION BY athlete_id) AS n,
  min(day) OVER (PARTITION BY athlete_id) AS first, max(day) OVER (PARTITION BY athlete_id) AS last FROM d), e AS (SELECT *, unnest(generate_series(1, u)) AS threshold, day > last - 90 AS recent FROM o WHERE u >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, threshold ORDER BY day) AS nth FROM e), t AS (SELECT athlete_id, threshold, count(*) AS days, max(day) FILTER (nth = threshold) AS achieved, max(k) FILTER (nth = threshold) AS active, any_value(first) AS first, any_value(n) AS n, count(*) FILTER (recent) AS rq FROM r GROUP BY 1, 2),
c AS (SELECT athlete_id, coalesce(max(threshold) FILTER (achieved IS NOT NULL), 0) AS current FROM t GROUP BY 1), ra AS (SELECT athlete_id, count(*) FILTER (day > last - 90) AS active FROM o GROUP BY 1)
SELECT t.athlete_id, CAST(threshold AS INTEGER) AS threshold, days, achieved, CAST(achieved - first + 1 AS BIGINT) AS days_needed, t.active AS active_days_needed, CASE WHEN achieved IS NOT NULL THEN t.active WHEN threshold <= current + 10 AND rq > 0 THEN CAST(n + ceil((threshold - days) * (ra.active / CAST(rq AS DOUBLE))) AS BIGINT) END AS projected_active_days
FROM t JOIN c ON c.athlete_id = t.athlete_id JOIN ra ON ra.athlete_id = t.athlete_id""")
def eddington_projection(spark, sf_dir):
    d = A.gear_uses(spark, sf_dir).groupBy((F.col("athlete_id") % 20).alias("athlete_id"), "day").agg(F.sum("km").alias("total"))
    return G.eddington_series(d, ["athlete_id"])


def _pools(pools) -> str:
    """Tables ``swim`` (metres in fives) and ``est``: the pool of each swim."""
    divides = ", ".join(f"CASE WHEN distance > 0 AND distance % {m} = 0 THEN '{n}' END" for n, m, _, _ in pools)
    fits = ", ".join(f"CASE WHEN distance > 0 AND moving_time > 0 AND distance % {m} = 0 AND moving_time / (distance / {m}) BETWEEN {a} AND {b} THEN {{'n': -coalesce((SELECT n FROM counts WHERE counts.athlete_id = swim.athlete_id AND pool = '{n}'), 0), 'at': {k}, 'name': '{n}'}} END" for k, (n, m, a, b) in enumerate(pools))
    return f"""{A.ACTIVITIES}, swim AS (SELECT id, athlete_id % 7 AS athlete_id, floor(distance / 5) * 5 AS distance, moving_time FROM activity), fit AS (SELECT athlete_id, list_filter([{divides}], lambda x: x IS NOT NULL) AS f FROM swim),
counts AS (SELECT athlete_id, f[1] AS pool, count(*) AS n FROM fit WHERE len(f) = 1 GROUP BY 1, 2), est AS (SELECT id, list_sort(list_filter([{fits}], lambda x: x IS NOT NULL))[1].name AS pool FROM swim)"""


def _swims(spark, sf_dir):
    return A.activities(spark, sf_dir).select("id", (F.col("athlete_id") % 7).alias("athlete_id"), (F.floor(F.col("distance") / 5) * 5).cast("double").alias("distance"), "moving_time")


@query(f"WITH {_pools(enrich.METRIC_POOLS)} SELECT id, pool FROM est")
def pool_estimates(spark, sf_dir):
    return enrich.with_pool(_swims(spark, sf_dir), ["athlete_id"]).select("id", "pool")


@query(f"WITH {_pools(enrich.MIXED_POOLS)} SELECT id, pool FROM est")
def pool_estimates_mixed(spark, sf_dir):
    return enrich.with_pool(_swims(spark, sf_dir), ["athlete_id"], enrich.MIXED_POOLS).select("id", "pool")


@query(f"""WITH {A.POINTS}, {STEPS}, p AS (SELECT *, CASE WHEN step_m > 0 AND d_time > 0 AND idx > 0 THEN 1000 / (step_m / d_time) / 60 END AS pace, CASE WHEN sport_type = 'Run' THEN cadence * 2 ELSE cadence END AS feet FROM k)
SELECT activity_id, CAST(idx AS INTEGER) AS idx, {number('pace', 3)} AS pace, {number('avg(pace) OVER (PARTITION BY activity_id ORDER BY idx ROWS 9 PRECEDING)', 3)} AS pace_smooth, feet AS steps_a_minute FROM p""")
def pace_stream(spark, sf_dir):
    p = P.pace_stream(A.points(spark, sf_dir), 10)
    return p.select("activity_id", "idx", S.half_up(F.col("pace"), 3).alias("pace"), S.half_up(F.col("pace_smooth"), 3).alias("pace_smooth"), "steps_a_minute")


@query(f"""WITH {A.POINTS}, {STEPS}, p AS (SELECT activity_id, idx, d_time / step_m AS v FROM k WHERE step_m > 0 AND d_time > 0 AND idx > 0), a AS (SELECT activity_id, avg(v) OVER (PARTITION BY activity_id ORDER BY idx ROWS 4 PRECEDING) AS s FROM p), b AS (SELECT activity_id, avg(heart_rate) OVER (PARTITION BY activity_id ORDER BY idx ROWS 4 PRECEDING) AS s FROM k),
x AS (SELECT activity_id, stddev_samp(s) / avg(s) * 100 AS pace_cv FROM a WHERE s > 0 GROUP BY 1), y AS (SELECT activity_id, stddev_samp(s) / avg(s) * 100 AS hr_cv FROM b WHERE s > 0 GROUP BY 1) SELECT y.activity_id, {number('pace_cv', 3)} AS pace_cv, {number('hr_cv', 3)} AS hr_cv FROM y LEFT JOIN x ON x.activity_id = y.activity_id""")
def stream_variability(spark, sf_dir):
    p = P.pace_stream(A.points(spark, sf_dir))
    both = P.variability(p, "heart_rate", 5).withColumnRenamed("cv", "hr_cv").join(P.variability(p, "pace", 5, skip_missing=True).withColumnRenamed("cv", "pace_cv"), "activity_id", "left")
    return both.select("activity_id", S.half_up(F.col("pace_cv"), 3).alias("pace_cv"), S.half_up(F.col("hr_cv"), 3).alias("hr_cv"))


@query(f"""WITH {A.ACTIVITIES}, a AS (SELECT *, distance / moving_time AS sp, {number('average_heartrate', 0)} AS hr FROM activity), s AS (SELECT athlete_id, sport_type, count(*) AS n, avg(average_heartrate) AS hr FROM a GROUP BY 1, 2), l AS (SELECT athlete_id, array_to_string(list(sport_type || ' ' || n || ' ' || coalesce(printf('%.0f', {number('hr', 0)}), '-') ORDER BY n DESC, sport_type), ', ') AS sports FROM s GROUP BY 1),
m AS (SELECT athlete_id, count(DISTINCT date_trunc('month', day)) AS months, count(*) AS recent FROM a WHERE day >= DATE '2024-01-01' - INTERVAL 11 MONTH AND day <= DATE '2024-01-28' GROUP BY 1), r AS (SELECT * FROM a WHERE sport_type IN ('Run', 'TrailRun')), w AS (SELECT athlete_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM a GROUP BY 1),
b AS (SELECT athlete_id, arg_max(day, (sp, -id)) FILTER (distance BETWEEN 4800 AND 5500) AS best_5k_day, {number('max(sp) FILTER (distance BETWEEN 4800 AND 5500)', 5)} AS best_5k_speed, arg_max(day, (distance, -id)) AS longest_run_day FROM r GROUP BY 1), f AS (SELECT athlete_id, arg_max(day, (sp, -id)) AS fastest_ride_day FROM a WHERE sport_type = 'Ride' GROUP BY 1)
SELECT w.athlete_id, w.n, first_day, last_day, sports, coalesce(months, 0) AS months, coalesce(recent, 0) AS recent, best_5k_day, best_5k_speed, longest_run_day, fastest_ride_day FROM w JOIN l ON l.athlete_id = w.athlete_id LEFT JOIN m ON m.athlete_id = w.athlete_id LEFT JOIN b ON b.athlete_id = w.athlete_id LEFT JOIN f ON f.athlete_id = w.athlete_id""")
def coach_context(spark, sf_dir):
    c = R.coach_context(A.activities(spark, sf_dir), ["athlete_id"], "2024-01-28")
    one = lambda s: F.concat_ws(" ", s["sport_type"], s["n"].cast("string"), F.when(s["hr"].isNotNull(), F.format_string("%.0f", S.half_up(s["hr"]))).otherwise("-"))
    return c.select(
        "athlete_id", "n", "first_day", "last_day", F.array_join(F.transform("sports", one), ", ").alias("sports"), F.coalesce(F.size("months"), F.lit(0)).cast("long").alias("months"), F.coalesce(F.aggregate("months", F.lit(0).cast("long"), lambda a, m: a + m["n"]), F.lit(0)).alias("recent"),
        "best_5k_day", S.half_up(F.col("best_5k_speed"), 5).alias("best_5k_speed"), F.col("longest_run.day").alias("longest_run_day"), F.col("fastest_ride.day").alias("fastest_ride_day"),
    )


@query(f"""WITH {A.ACTIVITIES}, u AS (SELECT *, id % 40 AS gear_id, hour(start_ts) AS h FROM activity), w AS (SELECT gear_id, isodow(day) - 1 AS v, count(*) AS k FROM u GROUP BY 1, 2), wd AS (SELECT gear_id, CAST(arg_min(v, (-k, v)) AS INTEGER) AS weekday FROM w GROUP BY 1), hh AS (SELECT gear_id, h AS v, count(*) AS k FROM u GROUP BY 1, 2), hd AS (SELECT gear_id, CAST(arg_min(v, (-k, v)) AS INTEGER) AS hour FROM hh GROUP BY 1),
g AS (SELECT gear_id, count(*) AS n, sum(CAST(distance / 1000 AS DECIMAL(18,6))) AS km, sum(moving_time) / CAST(3600 AS DOUBLE) AS hours, min(day) AS a, max(day) AS b, max(distance) / 1000 AS longest, min(moving_time / (distance / 1000)) FILTER (distance > 0 AND moving_time > 0) AS best_pace, max(distance / moving_time) * CAST(3.6 AS DOUBLE) AS top_speed, count(average_heartrate) FILTER (average_heartrate > 0) AS hr_n, avg(average_heartrate) FILTER (average_heartrate > 0) AS hr, max(average_heartrate) AS hr_max FROM u GROUP BY 1)
SELECT g.gear_id, n, {number('CAST(km AS DOUBLE)', 3)} AS km, {number('hours', 3)} AS hours, {number('CAST(km AS DOUBLE) / n', 3)} AS mean_km, {number("CAST(km AS DOUBLE) / greatest(1, greatest(1, b - a) / CAST(7 AS DOUBLE))", 3)} AS km_week, CAST(greatest(1, b - a) AS BIGINT) AS span_days, weekday, hour, {number('longest', 3)} AS longest_km, {number('best_pace', 2)} AS best_pace,
  {number('CAST(km AS DOUBLE) / hours', 3)} AS speed, {number('top_speed', 3)} AS top_speed, {number('hr_n * CAST(100 AS DOUBLE) / n', 2)} AS hr_cover, {number('hr', 3)} AS hr, hr_max FROM g JOIN wd ON wd.gear_id = g.gear_id JOIN hd ON hd.gear_id = g.gear_id""")
def gear_profile(spark, sf_dir):
    u = A.activities(spark, sf_dir).withColumn("gear_id", F.col("id") % 40)
    digits = {"km": 3, "hours": 3, "mean_km": 3, "km_week": 3, "longest_km": 3, "best_pace": 2, "speed": 3, "top_speed": 3, "hr_cover": 2, "hr": 3}
    return C.gear_profile(u).withColumns({c: S.half_up(F.col(c), d) for c, d in digits.items()})


@query(f"""WITH {A.HISTORY}, d AS (SELECT DISTINCT day, date_trunc('week', day)::DATE AS m FROM history) SELECT day, year(m) || '-W' || lpad(CAST(CAST(ceil((m - make_date(year(m), 1, 1) + 1) / CAST(7 AS DOUBLE)) AS BIGINT) AS VARCHAR), 2, '0') AS label FROM d""")
def week_labels(spark, sf_dir):
    return A.history(spark, sf_dir).select("day").distinct().select("day", S.week_label(F.col("day")).alias("label"))


@query(f"""WITH {A.ACTIVITIES}, d AS (SELECT athlete_id, avg(CAST(average_heartrate AS DECIMAL(18,6))) FILTER (day < DATE '2024-01-16') AS h0, avg(CAST(average_heartrate AS DECIMAL(18,6))) FILTER (day >= DATE '2024-01-16') AS h1, count(*) FILTER (day < DATE '2024-01-16') AS n0, count(*) FILTER (day >= DATE '2024-01-16') AS n1 FROM activity GROUP BY 1)
SELECT athlete_id, CASE WHEN h1 = h0 THEN 'same' WHEN h1 < h0 THEN 'better' WHEN h1 IS NOT NULL AND h0 IS NOT NULL THEN 'worse' END AS hr, CASE WHEN n1 = n0 THEN 'same' WHEN n1 > n0 THEN 'better' ELSE 'worse' END AS activities FROM d""")
def metric_trends(spark, sf_dir):
    late, hr = F.col("day") >= F.lit("2024-01-16").cast("date"), F.col("average_heartrate")
    d = A.activities(spark, sf_dir).groupBy("athlete_id").agg((S.exact_mean(F.when(late, hr)) - S.exact_mean(F.when(~late, hr))).alias("h"), (F.count_if(late) - F.count_if(~late)).alias("n"))
    return d.select("athlete_id", S.trend(F.lit("hr"), F.col("h")).alias("hr"), S.trend(F.lit("activities"), F.col("n")).alias("activities"))


@query(f"""WITH {A.LAPS}, e AS (SELECT activity_id, lap, km * 1000 AS distance, seconds AS moving_time, CASE WHEN strokes % 5 < 2 THEN strokes % 5 + 1 WHEN strokes % 7 = 0 THEN NULL ELSE 0 END AS pr_rank, CASE WHEN strokes % 11 < 3 THEN strokes % 11 + 1 END AS kom_rank FROM laps)
SELECT activity_id, lap, {number('(moving_time / CAST(60 AS DOUBLE)) / (distance / CAST(1000 AS DOUBLE))', 4)} AS pace, CASE WHEN pr_rank = 1 THEN 'PR!' WHEN pr_rank > 1 THEN 'PR #' || pr_rank WHEN kom_rank = 1 THEN 'KOM/QOM!' WHEN kom_rank > 1 THEN 'Top ' || kom_rank ELSE '' END AS rank FROM e""")
def segment_efforts(spark, sf_dir):
    s = F.col("strokes")
    e = A.laps(spark, sf_dir).select("activity_id", "lap", (F.col("km") * 1000).alias("distance"), F.col("seconds").alias("moving_time"), F.when(s % 5 < 2, s % 5 + 1).when(s % 7 == 0, None).otherwise(0).alias("pr_rank"), F.when(s % 11 < 3, s % 11 + 1).alias("kom_rank"))
    return analysers.efforts_table(e).select("activity_id", "lap", S.half_up(F.col("pace"), 4).alias("pace"), "rank")
