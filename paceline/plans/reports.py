"""Report queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import load
from paceline.operators import reports as R
from paceline.plans.base import number, query
from paceline.plans.training import DAILY, MODEL, model
from paceline.sources import adapters as A


def cut(df, digits: int, *columns: str):
    return df.withColumns({c: S.half_up(F.col(c), digits) for c in columns})


@query(f"""WITH {A.ACTIVITIES}, w AS (SELECT athlete_id, date_diff('day', day, DATE '2024-01-28') AS age, distance FROM activity), k AS (SELECT athlete_id, count(*) FILTER (age BETWEEN 0 AND 6) AS n_now, count(*) FILTER (age BETWEEN 7 AND 13) AS n_before,
  coalesce(sum(distance) FILTER (age BETWEEN 0 AND 6), 0) AS a, coalesce(sum(distance) FILTER (age BETWEEN 7 AND 13), 0) AS b FROM w WHERE age BETWEEN 0 AND 13 GROUP BY 1)
SELECT athlete_id, n_now, n_before, {number('a', 2)} AS distance_now, {number('b', 2)} AS distance_before, {number('(a - b) * 100 / nullif(b, 0)', 3)} AS distance_change FROM k""")
def window_kpis(spark, sf_dir):
    k = R.window_kpis(A.activities(spark, sf_dir), ["athlete_id"], "2024-01-28", 7, {"distance": F.col("distance")})
    return cut(cut(k, 3, "distance_change"), 2, "distance_now", "distance_before")


@query(f"""WITH {A.ACTIVITIES}, s AS (SELECT athlete_id, count(*) AS n, avg(CASE WHEN sport_type IN ('Run', 'TrailRun') THEN CAST(1 AS DOUBLE) ELSE 0 END) AS r, avg(CASE WHEN sport_type = 'Ride' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS c,
  avg(CASE WHEN sport_type = 'Swim' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s, avg(CASE WHEN sport_type = 'Workout' THEN CAST(1 AS DOUBLE) ELSE 0 END) AS g FROM activity GROUP BY 1),
k AS (SELECT *, CAST(r >= 0.15 AS INTEGER) + CAST(c >= 0.15 AS INTEGER) + CAST(s >= 0.15 AS INTEGER) + CAST(g >= 0.25 AS INTEGER) AS k FROM s)
SELECT athlete_id, n, CASE WHEN k >= 3 THEN 'triathlete' WHEN k = 2 THEN 'mixed' WHEN r >= 0.15 THEN 'runner' WHEN c >= 0.15 THEN 'cyclist' WHEN s >= 0.15 THEN 'swimmer' WHEN g >= 0.25 THEN 'gym' ELSE 'general' END AS profile FROM k""")
def sport_profile(spark, sf_dir):
    return R.sport_profile(A.activities(spark, sf_dir), ["athlete_id"]).select("athlete_id", "n", "profile")


@query(f"""WITH {A.ACTIVITIES}, {DAILY}, b AS (SELECT athlete_id, day, greatest(ctl * 7, 10) * CAST(0.75 AS DOUBLE) AS lo, greatest(ctl * 7, 10) * CAST(1.3 AS DOUBLE) AS hi FROM model) SELECT athlete_id, day, {number('greatest(0, (lo + hi) / 2 - greatest(hi - lo, 30) / 2)', 3)} AS band_low, {number('(lo + hi) / 2 + greatest(hi - lo, 30) / 2', 3)} AS band_high FROM b""")
def acute_load_band(spark, sf_dir):
    return cut(R.acute_band(model(spark, sf_dir)).select("athlete_id", "day", "band_low", "band_high"), 3, "band_low", "band_high")


@query(f"""WITH {A.HISTORY}, a AS (SELECT DISTINCT athlete_id FROM history), m AS (SELECT athlete_id, CAST(range AS INTEGER) AS month FROM a, range(1, 13)), s AS (SELECT athlete_id, CAST(month(day) AS INTEGER) AS month, sum(distance) AS v FROM history WHERE year(day) = 1998 GROUP BY 1, 2),
c AS (SELECT m.athlete_id, m.month, sum(coalesce(v, 0)) OVER (PARTITION BY m.athlete_id ORDER BY m.month ROWS UNBOUNDED PRECEDING) AS so_far FROM m LEFT JOIN s ON m.athlete_id = s.athlete_id AND m.month = s.month)
SELECT athlete_id, month, {number('so_far', 2)} AS so_far, {number('month * CAST(120000 AS DOUBLE) / 12', 2)} AS plan, {number('greatest(0, 120000 - so_far)', 2)} AS missing FROM c""")
def goal_progress(spark, sf_dir):
    return cut(R.goal_progress(A.history(spark, sf_dir), ["athlete_id"], 1998, 120000.0), 2, "so_far", "plan", "missing")


@query(f"""WITH e AS (SELECT CAST(40 AS DOUBLE) + event_id % 97 / CAST(1000 AS DOUBLE) AS lat, CAST(-3 AS DOUBLE) + event_id % 89 / CAST(1000 AS DOUBLE) AS lon FROM events)
SELECT {number('lat', 2)} AS lat, {number('lon', 2)} AS lon, count(*) AS n FROM e GROUP BY 1, 2""")
def map_density(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return R.density(e, 40.0 + F.col("event_id") % 97 / 1000.0, -3.0 + F.col("event_id") % 89 / 1000.0)


@query(f"""WITH {A.HISTORY}, n AS (SELECT * FROM history WHERE abs(date_diff('day', make_date(2000, 6, 15), make_date(2000, month(day), day(day)))) <= 10 AND year(day) <> 1998) SELECT count(*) AS n, {number('avg(distance)', 3)} AS distance, {number('avg(moving_time)', 3)} AS moving_time FROM n""")
def seasonal_neighbourhood(spark, sf_dir):
    return cut(R.seasonal(A.history(spark, sf_dir), "1998-06-15", 10, ["distance", "moving_time"]), 3, "distance", "moving_time")


@query(f"""WITH {A.ACTIVITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY day, id) AS rn, count(*) OVER (PARTITION BY athlete_id) AS n FROM activity WHERE average_heartrate IS NOT NULL AND distance > 0),
p AS (SELECT *, CASE WHEN rn <= n // 3 THEN 'first' WHEN rn > n - n // 3 THEN 'last' END AS part FROM r), b AS (SELECT part, CAST(b.range AS INTEGER) AS bin, moving_time / CAST(60 AS DOUBLE) / (distance / 1000) AS pace FROM p, range(110, 195, 5) b WHERE part IS NOT NULL AND abs(average_heartrate - b.range) < 2.5)
SELECT part, bin, count(*) AS n, {number('avg(pace)', 4)} AS pace FROM b GROUP BY 1, 2""")
def heart_rate_bin_curve(spark, sf_dir):
    a = A.activities(spark, sf_dir).where("average_heartrate is not null and distance > 0")
    return cut(R.heart_rate_bins(a, ["athlete_id"], list(range(110, 195, 5))), 4, "pace")


@query(f"""WITH {A.HISTORY}, w AS (SELECT athlete_id, date_trunc('week', day)::DATE AS week, sum(distance) / 1000 AS d, max(distance) / 1000 AS longest FROM history WHERE day > DATE '2000-06-30' - INTERVAL 56 DAY AND day <= DATE '2000-06-30' GROUP BY 1, 2)
SELECT athlete_id, count(*) AS active_weeks, {number('avg(d)', 4)} AS mean_km, {number('max(d)', 4)} AS max_km, {number('max(longest)', 4)} AS longest_km, count(*) / CAST(8 AS DOUBLE) AS consistency FROM w GROUP BY 1""")
def training_summary(spark, sf_dir):
    return cut(R.training_summary(A.history(spark, sf_dir), ["athlete_id"], "2000-06-30"), 4, "mean_km", "max_km", "longest_km")


@query("""WITH e AS (SELECT user_id AS athlete_id, CAST(event_id * 37 % 360 AS DOUBLE) AS r, CAST(event_id * 53 % 360 AS DOUBLE) AS w FROM events), d AS (SELECT athlete_id, abs(r - (w + 180) % 360) % 360 AS d FROM e), o AS (SELECT athlete_id, CASE WHEN d > 180 THEN 360 - d ELSE d END AS o FROM d),
c AS (SELECT athlete_id, count(*) FILTER (o <= 45) AS tail, count(*) FILTER (o >= 135) AS head, count(*) FILTER (o > 45 AND o < 135) AS "cross" FROM o GROUP BY 1)
SELECT *, CASE WHEN tail = greatest(tail, head, "cross") THEN 'tail' WHEN head = greatest(tail, head, "cross") THEN 'head' ELSE 'cross' END AS main FROM c""")
def wind_summary(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumnRenamed("user_id", "athlete_id")
    return R.wind_summary(e, ["athlete_id"], (F.col("event_id") * 37 % 360).cast("double"), (F.col("event_id") * 53 % 360).cast("double"))


@query(f"""WITH {A.HISTORY}, t AS (SELECT *, moving_time / CAST(3600 AS DOUBLE) * 36 AS tss FROM history), s AS (SELECT athlete_id, avg(tss) AS mean, list(distance ORDER BY distance) AS d FROM t GROUP BY 1)
SELECT id, CASE WHEN distance >= d[CAST(least(floor(len(d) * CAST(0.8 AS DOUBLE)), len(d) - 1) AS INTEGER) + 1] AND workout_type <> 'F' THEN 'long' WHEN workout_type = 'F' THEN 'race' WHEN tss > 1.5 * mean THEN 'hard' WHEN tss < 0.5 * mean THEN 'easy' ELSE 'other' END AS workout FROM t JOIN s ON t.athlete_id = s.athlete_id""")
def run_workout_class(spark, sf_dir):
    runs = A.history(spark, sf_dir).withColumns({"tss": F.col("moving_time") / 3600.0 * 36, "workout_type": F.when(F.col("workout_type") == "F", 1).otherwise(0)})
    return R.workout_class(runs, ["athlete_id"]).select("id", "workout")


@query(f"""WITH {A.POINTS}, g AS (SELECT activity_id, count(*) AS n, avg(speed) AS ms, list(speed ORDER BY speed) AS s, avg(heart_rate) AS mh, max(heart_rate) AS max_hr, stddev_pop(heart_rate) AS sd, avg(power) AS mp, avg(CASE WHEN grade > 2 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS up, avg(CASE WHEN grade < -2 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS down FROM point GROUP BY 1)
SELECT activity_id, n, {number('ms', 4)} AS mean_speed, s[n // 2 + 1] AS median_speed, {number('mh', 4)} AS mean_hr, max_hr, {number('sd', 4)} AS sd_hr, {number('mp', 4)} AS mean_power, {number('up', 5)} AS up, {number('down', 5)} AS down, {number('ms / nullif(mh, 0)', 6)} AS speed_per_beat FROM g""")
def track_stats(spark, sf_dir):
    t = R.track_stats(A.points(spark, sf_dir))
    return cut(cut(cut(t, 4, "mean_speed", "mean_hr", "sd_hr", "mean_power"), 5, "up", "down"), 6, "speed_per_beat")


@query(f"""WITH {A.POINTS}, z AS (SELECT * FROM (VALUES (1, 0, 130), (2, 130, 160), (3, 160, 100000)) v(zone, lo, hi)), c AS (SELECT activity_id, CAST(zone AS INTEGER) AS zone, count(*) AS n FROM point JOIN z ON heart_rate >= lo AND heart_rate < hi GROUP BY 1, 2) SELECT *, {number('n / sum(n) OVER (PARTITION BY activity_id)', 5)} AS share FROM c""")
def heart_rate_zone_shares(spark, sf_dir):
    return cut(R.zone_shares(A.points(spark, sf_dir), [(0, 130), (130, 160), (160, -1)]), 5, "share")


@query(f"WITH {A.ACTIVITIES}, r AS (SELECT athlete_id, day, id, sport_type, row_number() OVER (PARTITION BY athlete_id, day ORDER BY start_ts DESC, id DESC) AS k FROM activity) SELECT athlete_id, day, id, sport_type FROM r WHERE k = 1")
def last_activity_of_day(spark, sf_dir):
    a = A.activities(spark, sf_dir).select("athlete_id", "day", "start_ts", "id", "sport_type")
    return R.last_of_key(a, ["athlete_id", "day"], ["start_ts", "id"]).drop("start_ts")


@query(f"WITH {A.HISTORY}, a AS (SELECT id, distance, 'top' AS \"end\" FROM history ORDER BY distance DESC, id LIMIT 5), b AS (SELECT id, distance, 'bottom' AS \"end\" FROM history ORDER BY distance, id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b")
def top_and_bottom_5(spark, sf_dir):
    return R.extremes(A.history(spark, sf_dir).select("id", "distance"), "distance", 5, "id")


@query(f"WITH {A.ACTIVITIES}, {DAILY} SELECT athlete_id, day, {number('cume_dist() OVER (PARTITION BY athlete_id ORDER BY ' + number('ctl', 4) + ')', 6)} AS rank FROM model")
def fitness_percentile(spark, sf_dir):
    m = model(spark, sf_dir).withColumn("c", S.half_up(F.col("ctl"), 4))
    return m.select("athlete_id", "day", S.half_up(F.cume_dist().over(Window.partitionBy("athlete_id").orderBy("c")), 6).alias("rank"))


@query(f"""WITH {A.ACTIVITIES}, d AS (SELECT athlete_id, day, sum(distance) AS load FROM activity GROUP BY 1, 2), spine AS (SELECT athlete_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY athlete_id),
daily AS (SELECT s.athlete_id, s.day, coalesce(load, 0) AS load FROM spine s LEFT JOIN d ON s.athlete_id = d.athlete_id AND s.day = d.day), {MODEL} SELECT athlete_id, day, {number('atl', 3)} AS atl, {number('ctl', 3)} AS ctl, tsb FROM model""")
def calendar_fitness(spark, sf_dir):
    daily = load.daily_load(A.activities(spark, sf_dir), "distance")
    return load.fitness_and_fatigue(daily, calendar=True).select("athlete_id", "day", S.half_up(F.col("atl"), 3).alias("atl"), S.half_up(F.col("ctl"), 3).alias("ctl"), "tsb")
