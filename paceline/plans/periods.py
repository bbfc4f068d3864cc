"""Filters, group-bys, top-k, joins and fits over activities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import aggregates as G
from paceline.operators import enrich, joins, query as adhoc, windows
from paceline.plans.base import number, query
from paceline.sources import adapters as A

TARGETS = [(5.0, 0.1), (10.0, 0.1), (21.097, 0.05), (42.195, 0.05)]


@query(f"WITH {A.ACTIVITIES} SELECT id, athlete_id, day FROM activity WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def date_range_filter(spark, sf_dir):
    return adhoc.in_days(A.activities(spark, sf_dir), "2024-01-05", "2024-01-20").select("id", "athlete_id", "day")


@query(f"WITH {A.ACTIVITIES} SELECT id, sport_type, distance FROM activity WHERE sport_type IN ('Run', 'TrailRun') AND coalesce(distance, 0) BETWEEN 5000 AND 40000 AND coalesce(moving_time, 0) / 60 >= 20 AND average_heartrate BETWEEN 120 AND 180")
def adhoc_multi_filter(spark, sf_dir):
    q = adhoc.ActivityQuery(sports=("Run", "TrailRun"), distance_km=(5, 40), minutes=(20, None), heart_rate=(120, 180))
    return q.filtered(A.activities(spark, sf_dir)).select("id", "sport_type", "distance")


@query(f"WITH {A.HISTORY} SELECT date_trunc('month', day)::DATE AS period, count(*) AS n, {number('sum(distance)', 2)} AS distance FROM history WHERE sport_type LIKE '%HIGH%' OR sport_type LIKE '%URGENT%' GROUP BY 1")
def sport_substring_volume(spark, sf_dir):
    h = A.history(spark, sf_dir).where(F.col("sport_type").contains("HIGH") | F.col("sport_type").contains("URGENT"))
    return h.groupBy(G.period_start(F.col("day"), "month").alias("period")).agg(F.count("*").alias("n"), S.half_up(F.sum("distance"), 2).alias("distance"))


def _dense(period: str, step: str, table: str = "history") -> str:
    return f"""WITH {A.HISTORY}, s AS (SELECT date_trunc('{period}', day)::DATE AS period, sum(distance) AS total, count(*) AS n FROM history GROUP BY 1),
p AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM s), (SELECT max(period) FROM s), INTERVAL {step})) AS DATE) AS period)
SELECT p.period, {number('coalesce(total, 0)', 2)} AS total, coalesce(n, 0) AS n FROM p LEFT JOIN s ON p.period = s.period"""


def _volume(spark, sf_dir, period):
    h = A.history(spark, sf_dir).withColumn("everyone", F.lit(1))
    return G.dense_volume(h, period, ["everyone"]).select("period", S.half_up(F.col("total"), 2).alias("total"), "n")


@query(_dense("week", "7 DAY"))
def weekly_volume_dense(spark, sf_dir):
    return _volume(spark, sf_dir, "week")


@query(_dense("month", "1 MONTH"))
def monthly_volume_dense(spark, sf_dir):
    return _volume(spark, sf_dir, "month")


@query(f"""WITH {A.HISTORY} SELECT year(day) || '-Q' || quarter(day) AS quarter, {', '.join(f"{number(f'''coalesce(sum(distance) FILTER (sport_type = '{k}'), 0)''', 2)} AS {n}" for k, n in (('1-URGENT', 'urgent'), ('2-HIGH', 'high'), ('3-MEDIUM', 'medium')))} FROM history GROUP BY 1""")
def quarterly_sport_pivot(spark, sf_dir):
    h = A.history(spark, sf_dir).withColumn("quarter", F.concat(F.year("day"), F.lit("-Q"), F.quarter("day")))
    wide = h.groupBy("quarter").pivot("sport_type", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.sum("distance")).fillna(0.0)
    return wide.select("quarter", *[S.half_up(F.col(f"`{k}`"), 2).alias(n) for k, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"))])


@query(f"""WITH {A.HISTORY}, w AS (SELECT athlete_id, date_trunc('week', day)::DATE AS week, sum(distance) AS d FROM history GROUP BY 1, 2)
SELECT athlete_id, week, {number('avg(d) OVER (PARTITION BY athlete_id ORDER BY week ROWS 25 PRECEDING)', 2)} AS mean26 FROM w""")
def rolling_weekly_mean_26(spark, sf_dir):
    w = A.history(spark, sf_dir).groupBy("athlete_id", S.week_start(F.col("day")).alias("week")).agg(F.sum("distance").alias("d"))
    return w.select("athlete_id", "week", S.half_up(windows.rolling_mean("d", 26, ["athlete_id"], ["week"]), 2).alias("mean26"))


@query(f"WITH {A.HISTORY} SELECT id, {number('sum(distance) OVER (PARTITION BY athlete_id ORDER BY day, id ROWS UNBOUNDED PRECEDING)', 2)} AS so_far FROM history")
def running_total(spark, sf_dir):
    return A.history(spark, sf_dir).select("id", S.half_up(windows.running_total("distance", ["athlete_id"], ["day", "id"]), 2).alias("so_far"))


@query(f"WITH {A.HISTORY} SELECT id, {number('avg(distance) OVER (PARTITION BY athlete_id ORDER BY day, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 3)} AS smooth FROM history")
def centred_mean_5(spark, sf_dir):
    return A.history(spark, sf_dir).select("id", S.half_up(windows.centred_mean("distance", 2, 2, ["athlete_id"], ["day", "id"]), 3).alias("smooth"))


_LOCAL = "CASE WHEN abs(b.i - a.i) / (w / 2) >= 1 THEN 0 ELSE pow(1 - pow(abs(b.i - a.i) / (w / 2), 3), 3) END"


@query(f"""WITH {A.HISTORY}, m AS (SELECT athlete_id % 10 AS team, date_trunc('week', day)::DATE AS period, sum(distance) AS total FROM history GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY period) AS i, greatest(CAST(5 AS DOUBLE), floor(count(*) OVER (PARTITION BY team) * CAST(0.1 AS DOUBLE))) AS w FROM m)
SELECT a.team, a.period, {number(f"sum({_LOCAL} * b.total) / sum({_LOCAL})", 1)} AS trend FROM n a JOIN n b ON a.team = b.team AND abs(a.i - b.i) <= floor(a.w / 2) GROUP BY 1, 2""".replace("(w / 2)", "(a.w / 2)"))
def tricube_trend(spark, sf_dir):
    m = A.history(spark, sf_dir).groupBy((F.col("athlete_id") % 10).alias("team"), G.period_start(F.col("day"), "week").alias("period")).agg(F.sum("distance").alias("total"))
    return windows.local_mean(m, "total", ["team"], ["period"], "trend").select("team", "period", S.half_up(F.col("trend"), 1).alias("trend"))


def _adhoc_sql(period: str) -> str:
    return f"""WITH {A.HISTORY}, h AS (SELECT *, date_trunc('{period}', day)::DATE AS period FROM history),
c AS (SELECT period, sport_type, count(*) AS k FROM h GROUP BY 1, 2), b AS (SELECT period, max(k) AS top FROM c GROUP BY 1),
m AS (SELECT c.period, min(sport_type) AS sport_type_mode, count(*) > 1 AS sport_type_tied FROM c JOIN b ON c.period = b.period AND k = top GROUP BY 1),
a AS (SELECT period, count(*) AS n, {number('sum(distance)', 1)} AS distance_sum, {number('avg(distance)', 3)} AS distance_avg, min(distance) AS distance_min, max(distance) AS distance_max FROM h GROUP BY 1)
SELECT a.*, sport_type_mode, sport_type_tied FROM a JOIN m ON a.period = m.period"""


def _adhoc(spark, sf_dir, period):
    out = G.by_period(A.history(spark, sf_dir), period, ["distance"], ["sport_type"])
    return out.withColumns({"distance_sum": S.half_up(F.col("distance_sum"), 1), "distance_avg": S.half_up(F.col("distance_avg"), 3)})


@query(_adhoc_sql("week"))
def period_groupby_week(spark, sf_dir):
    return _adhoc(spark, sf_dir, "week")


@query(_adhoc_sql("month"))
def period_groupby_month(spark, sf_dir):
    return _adhoc(spark, sf_dir, "month")


@query(_adhoc_sql("year"))
def period_groupby_year(spark, sf_dir):
    return _adhoc(spark, sf_dir, "year")


@query(f"WITH {A.ACTIVITIES} SELECT CAST(isodow(day) - 1 AS INTEGER) AS \"row\", {', '.join(f'count(*) FILTER (hour(start_ts) = {h}) AS h{h}' for h in range(24))} FROM activity GROUP BY 1")
def weekday_hour_matrix(spark, sf_dir):
    m = G.matrix(A.activities(spark, sf_dir), F.weekday("day"), F.hour("start_ts"), list(range(24)))
    return m.select("row", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


@query(f"WITH {A.HISTORY} SELECT CAST(year(day) AS INTEGER) AS \"row\", {', '.join(f'count(*) FILTER (month(day) = {m}) AS m{m}' for m in range(1, 13))} FROM history GROUP BY 1")
def year_month_matrix(spark, sf_dir):
    m = G.matrix(A.history(spark, sf_dir), F.year("day"), F.month("day"), list(range(1, 13)))
    return m.select("row", *[F.col(str(k)).alias(f"m{k}") for k in range(1, 13)])


@query(f"""WITH {A.ACTIVITIES}, b AS (SELECT CASE WHEN hour(start_ts) < 6 THEN 'night' WHEN hour(start_ts) < 12 THEN 'morning' WHEN hour(start_ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, CAST(floor((month(day) % 12) / 3) AS INTEGER) AS season FROM activity) SELECT part, season, count(*) AS n FROM b GROUP BY 1, 2""")
def part_of_day_and_season(spark, sf_dir):
    a = A.activities(spark, sf_dir)
    return a.groupBy(S.hour_bucket(F.hour("start_ts")).alias("part"), S.season(F.month("day")).alias("season")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.GEAR_USES}, b AS (SELECT CAST(floor(km / CAST(5 AS DOUBLE)) AS INTEGER) AS bin, count(*) AS n FROM gear_use GROUP BY 1), s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT s.bin, s.bin * CAST(5 AS DOUBLE) AS "from", coalesce(n, 0) AS n FROM s LEFT JOIN b ON s.bin = b.bin""")
def histogram_fixed(spark, sf_dir):
    return G.histogram(A.gear_uses(spark, sf_dir), F.col("km"), 0.0, 5.0, 10)


@query(f"""WITH {A.GEAR_USES}, e AS (SELECT min(effort) AS lo, max(effort) AS hi FROM gear_use) SELECT CAST(least(floor((effort - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM gear_use, e GROUP BY 1""")
def histogram_10_bins(spark, sf_dir):
    return G.ten_bins(A.gear_uses(spark, sf_dir), "effort")


@query(f"""WITH {A.ACTIVITIES}, d AS (SELECT athlete_id, day, count(*) AS k FROM activity GROUP BY 1, 2) SELECT k, count(*) AS days FROM d GROUP BY 1""")
def per_period_distribution(spark, sf_dir):
    return A.activities(spark, sf_dir).groupBy("athlete_id", "day").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("days"))


_GDAY = f"WITH {A.GEAR_USES}, d AS (SELECT athlete_id, day, sum(km) AS total FROM gear_use GROUP BY 1, 2)"


def _gear_days(spark, sf_dir):
    return A.gear_uses(spark, sf_dir).groupBy("athlete_id", "day").agg(F.sum("km").alias("total"))


@query(f"{_GDAY}, r AS (SELECT athlete_id, floor(total) AS u, row_number() OVER (PARTITION BY athlete_id ORDER BY floor(total) DESC, day) AS rank FROM d) SELECT athlete_id, count(*) FILTER (u >= rank) AS eddington, count(*) AS active_days FROM r GROUP BY 1")
def eddington_daily(spark, sf_dir):
    return G.eddington(_gear_days(spark, sf_dir), ["athlete_id"])


@query(f"WITH {A.GEAR_USES}, d AS (SELECT athlete_id, date_trunc('week', day)::DATE AS day, sum(km) AS total FROM gear_use GROUP BY 1, 2), r AS (SELECT athlete_id, floor(total) AS u, row_number() OVER (PARTITION BY athlete_id ORDER BY floor(total) DESC, day) AS rank FROM d) SELECT athlete_id, count(*) FILTER (u >= rank) AS eddington, count(*) AS active_days FROM r GROUP BY 1")
def eddington_weekly(spark, sf_dir):
    w = A.gear_uses(spark, sf_dir).groupBy("athlete_id", S.week_start(F.col("day")).alias("day")).agg(F.sum("km").alias("total"))
    return G.eddington(w, ["athlete_id"])


@query(f"""{_GDAY}, u AS (SELECT athlete_id, day, unnest(generate_series(1, CAST(floor(total) AS INTEGER))) AS threshold FROM d WHERE total >= 1), n AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, threshold ORDER BY day) AS nth FROM u)
SELECT athlete_id, CAST(threshold AS INTEGER) AS threshold, count(*) AS days, max(day) FILTER (nth = threshold) AS achieved FROM n GROUP BY 1, 2""")
def eddington_achievements(spark, sf_dir):
    return G.eddington_steps(_gear_days(spark, sf_dir), ["athlete_id"])


def _streak_sql(unit: str, k: str) -> str:
    return f"""WITH {A.ACTIVITIES}, s AS (SELECT DISTINCT athlete_id, date_trunc('{unit}', day)::DATE AS p FROM activity), n AS (SELECT *, {k} - row_number() OVER (PARTITION BY athlete_id ORDER BY p) AS g FROM s)
SELECT athlete_id, min(p) AS start, max(p) AS "end", count(*) AS length FROM n GROUP BY athlete_id, g"""


@query(_streak_sql("day", "date_diff('day', DATE '1970-01-05', p)"))
def day_streaks(spark, sf_dir):
    return G.streaks(A.activities(spark, sf_dir), ["athlete_id"], "day")


@query(_streak_sql("week", "date_diff('day', DATE '1970-01-05', p) // 7"))
def week_streaks(spark, sf_dir):
    return G.streaks(A.activities(spark, sf_dir), ["athlete_id"], "week")


@query(f"""WITH {A.ACTIVITIES}, t AS (SELECT *, epoch_us(start_ts) // 1000000 AS s, epoch_us(start_ts) // 1000000 + elapsed_time AS e FROM activity)
SELECT a.athlete_id, a.id AS a, b.id AS b, a.sport_type AS from_sport, b.sport_type AS to_sport, CAST(b.s - a.e AS BIGINT) AS gap FROM t a JOIN t b ON a.athlete_id = b.athlete_id AND b.s >= a.e AND b.s <= a.e + 7200 AND a.sport_type <> b.sport_type""")
def sport_transitions_2h(spark, sf_dir):
    return joins.transitions(A.activities(spark, sf_dir), 7200, ["athlete_id"])


@query(f"""WITH {A.ACTIVITIES}, z AS (SELECT * FROM (VALUES (1, 0, 120), (2, 120, 140), (3, 140, 160), (4, 160, 175), (5, 175, 100000)) v(zone, lo, hi)) SELECT CAST(zone AS INTEGER) AS zone, count(*) AS n, CAST(sum(moving_time) AS BIGINT) AS seconds FROM activity JOIN z ON average_heartrate >= lo AND average_heartrate < hi GROUP BY 1""")
def zone_range_join(spark, sf_dir):
    zoned = joins.zone_of(A.activities(spark, sf_dir), F.col("average_heartrate"), [(0, 120), (120, 140), (140, 160), (160, 175), (175, -1)])
    return zoned.groupBy("zone").agg(F.count("*").alias("n"), F.sum("moving_time").alias("seconds"))


@query(f"""WITH {A.ACTIVITIES}, p AS (SELECT a.id, b.start_ts AS t, b.id AS weather_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(epoch_us(a.start_ts) - epoch_us(b.start_ts)), b.start_ts, b.id) AS k
  FROM activity a LEFT JOIN activity b ON a.athlete_id = b.athlete_id AND b.sport_type = 'Workout' WHERE a.sport_type = 'Run') SELECT id, weather_id FROM p WHERE k = 1""")
def nearest_event_join(spark, sf_dir):
    a = A.activities(spark, sf_dir)
    runs = a.where("sport_type = 'Run'").select("id", "athlete_id", "start_ts")
    # of several partners at one moment the smallest id
    other = a.where("sport_type = 'Workout'").groupBy("athlete_id", "start_ts").agg(F.min("id").alias("weather_id")).withColumnRenamed("start_ts", "seen")
    return joins.nearest(runs, other, ["athlete_id"], "start_ts", "seen", ["weather_id"]).select("id", "weather_id")


_GEAR = "g AS (SELECT gear_id, count(*) AS uses, min(day) AS first_use, max(day) AS last_use, sum(km) AS km, count(*) FILTER (grade > 0.05) AS trail_uses, count(DISTINCT day) AS days FROM gear_use GROUP BY 1)"


@query(f"""WITH {A.GEAR_USES}, {_GEAR} SELECT gear_id, uses, first_use, last_use, {number('km', 2)} AS km, trail_uses, days, {number('km / 800 * 100', 4)} AS used_pct, km >= 800 AS "replace",
  {number('greatest(0, 800 - km) / (km / greatest(date_diff(\'day\', first_use, DATE \'2001-12-31\') / CAST(7 AS DOUBLE), 1))', 4)} AS weeks_left FROM g""")
def gear_lifecycle(spark, sf_dir):
    g = enrich.gear_wear(G.gear_summary(A.gear_uses(spark, sf_dir)), "2001-12-31", 800.0, 120.0)
    return g.select("gear_id", "uses", "first_use", "last_use", S.half_up(F.col("km"), 2).alias("km"), "trail_uses", "days", S.half_up(F.col("used_pct"), 4).alias("used_pct"), "replace", S.half_up(F.col("weeks_left"), 4).alias("weeks_left"))


@query(f"WITH {A.GEAR_USES}, {_GEAR} SELECT p_partkey AS gear_id, coalesce(p_name, p_brand) AS name, coalesce(uses, 0) AS uses, {number('coalesce(km, 0)', 2)} AS km FROM part LEFT JOIN g ON p_partkey = gear_id")
def gear_left_join(spark, sf_dir):
    g = G.gear_summary(A.gear_uses(spark, sf_dir)).select("gear_id", "uses", "km")
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gear_id"), F.coalesce("p_name", "p_brand").alias("name"))
    return part.join(g, "gear_id", "left").select("gear_id", "name", F.coalesce("uses", F.lit(0)).alias("uses"), S.half_up(F.coalesce("km", F.lit(0.0)), 2).alias("km"))


@query(f"WITH {A.GEAR_USES} SELECT athlete_id, count(*) AS n FROM gear_use WHERE gear_id IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def gear_semi_join(spark, sf_dir):
    small = A.table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("gear_id"))
    return A.gear_uses(spark, sf_dir).join(small, "gear_id", "left_semi").groupBy("athlete_id").agg(F.count("*").alias("n"))


@query(f"WITH {A.GEAR_USES}, u AS (SELECT DISTINCT gear_id FROM gear_use WHERE km >= 49) SELECT p_partkey AS gear_id FROM part WHERE p_partkey NOT IN (SELECT gear_id FROM u)")
def gear_anti_join(spark, sf_dir):
    used = A.gear_uses(spark, sf_dir).where("km >= 49").select("gear_id").distinct()
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gear_id")).join(used, "gear_id", "left_anti")


@query(f"WITH {A.HISTORY} SELECT id, distance FROM history ORDER BY distance DESC, id LIMIT 10")
def top10_sessions(spark, sf_dir):
    return A.history(spark, sf_dir).orderBy(F.desc("distance"), "id").limit(10).select("id", "distance")


_BANDS = "t AS (SELECT * FROM (VALUES (CAST(5 AS DOUBLE), CAST(0.1 AS DOUBLE)), (10, 0.1), (21.097, 0.05), (42.195, 0.05)) v(km, margin)), b AS (SELECT t.km AS target, id, athlete_id, distance / 1000 AS d, moving_time, moving_time / (distance / 1000) AS pace FROM history JOIN t ON distance / 1000 BETWEEN km * (1 - margin) AND km * (1 + margin))"


@query(f"WITH {A.HISTORY}, {_BANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pace, id) AS place FROM b) SELECT target, CAST(place AS INTEGER) AS place, id, moving_time FROM r WHERE place <= 3")
def top3_per_target_band(spark, sf_dir):
    b = _banded(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("target").orderBy("pace", "id"))
    return b.withColumn("place", place).where("place <= 3").select("target", "place", "id", "moving_time")


def _banded(spark, sf_dir):
    km = F.col("distance") / 1000.0
    return joins.within_bands(A.history(spark, sf_dir), km, TARGETS).withColumns({"d": km, "pace": F.col("moving_time") / km})


@query(f"""WITH {A.HISTORY}, {_BANDS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pace, id) AS place FROM b), best AS (SELECT * FROM r WHERE place <= 3)
SELECT best.id, t.km AS target, {number('moving_time * pow(t.km / d, CAST(1.06 AS DOUBLE))', 3)} AS predicted FROM best CROSS JOIN t WHERE abs(d - t.km) >= 0.1""")
def riegel_cross(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("target").orderBy("pace", "id"))
    best = _banded(spark, sf_dir).withColumn("place", place).where("place <= 3").drop("target")
    goals = F.explode(F.array(*[F.lit(k) for k, _ in TARGETS]))
    crossed = best.withColumn("target", goals).where(F.abs(F.col("d") - F.col("target")) >= 0.1)
    return crossed.select("id", "target", S.half_up(S.riegel(F.col("moving_time"), F.col("d"), F.col("target")), 3).alias("predicted"))


@query(f"""WITH {A.HISTORY}, v AS (SELECT id, moving_time / CAST(60 AS DOUBLE) AS t, distance / (moving_time / CAST(60 AS DOUBLE)) AS v FROM history WHERE distance >= 3000)
SELECT id, {number('(CAST(-4.60 AS DOUBLE) + CAST(0.182258 AS DOUBLE) * v + CAST(0.000104 AS DOUBLE) * v * v) / (CAST(0.8 AS DOUBLE) + CAST(0.1894393 AS DOUBLE) * exp(CAST(-0.012778 AS DOUBLE) * t) + CAST(0.2989558 AS DOUBLE) * exp(CAST(-0.1932605 AS DOUBLE) * t))', 4)} AS vdot FROM v""")
def vdot_forward(spark, sf_dir):
    return A.history(spark, sf_dir).where("distance >= 3000").select("id", S.half_up(S.vdot(F.col("distance"), F.col("moving_time")), 4).alias("vdot"))


@query(f"""WITH {A.HISTORY}, {_BANDS}, p AS (SELECT athlete_id, target, moving_time * pow(target / d, CAST(1.06 AS DOUBLE)) AS time FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, target ORDER BY time) - 1 AS k, count(*) OVER (PARTITION BY athlete_id, target) AS n FROM p)
SELECT athlete_id, target, {number('avg(time)', 3)} AS blended, {number('min(time)', 3)} AS low, {number('max(time)', 3)} AS high FROM r WHERE k >= floor(n * CAST(0.25 AS DOUBLE)) AND k < ceil(n * CAST(0.75 AS DOUBLE)) GROUP BY 1, 2""")
def trimmed_blend(spark, sf_dir):
    from paceline.operators.predict import trimmed

    p = _banded(spark, sf_dir).select("athlete_id", "target", S.riegel(F.col("moving_time"), F.col("d"), F.col("target")).alias("time"), F.lit(1.0).alias("weight"))
    return trimmed(p, ["athlete_id", "target"], 0.25, 0.75).select("athlete_id", "target", *[S.half_up(F.col(c), 3).alias(c) for c in ("blended", "low", "high")])


@query(f"""WITH {A.HISTORY} SELECT athlete_id, arg_max(id, (distance, -id)) AS longest, arg_max(id, (moving_time, -id)) AS slowest, arg_max(id, (distance / moving_time, -id)) AS fastest, count(*) AS n FROM history GROUP BY 1""")
def records_argmax(spark, sf_dir):
    from paceline.operators.predict import records

    return records(A.history(spark, sf_dir), ["athlete_id"], {"longest": F.col("distance"), "slowest": F.col("moving_time"), "fastest": F.col("distance") / F.col("moving_time")})


@query(f"""WITH {A.HISTORY}, w AS (SELECT athlete_id, date_trunc('month', day)::DATE AS period, {number('sum(distance)', 2)} AS total FROM history GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY total DESC, period) AS k FROM w) SELECT athlete_id, period, total FROM r WHERE k = 1""")
def best_month(spark, sf_dir):
    m = A.history(spark, sf_dir).groupBy("athlete_id", G.period_start(F.col("day"), "month").alias("period")).agg(S.half_up(F.sum("distance"), 2).alias("total"))
    k = F.row_number().over(Window.partitionBy("athlete_id").orderBy(F.desc("total"), "period"))
    return m.withColumn("k", k).where("k = 1").drop("k")


@query(f"""WITH {A.HISTORY}, y AS (SELECT CAST(year(day) AS INTEGER) AS y, sport_type, sum(distance) AS d FROM history GROUP BY 1, 2)
SELECT a.y, a.sport_type, {number('a.d', 1)} AS d, {number('(a.d - b.d) * 100 / b.d', 4)} AS change FROM y a LEFT JOIN y b ON a.sport_type = b.sport_type AND a.y = b.y + 1""")
def yoy_by_type(spark, sf_dir):
    y = A.history(spark, sf_dir).groupBy(F.year("day").alias("y"), "sport_type").agg(F.sum("distance").alias("d"))
    before = y.select((F.col("y") + 1).alias("y"), "sport_type", F.col("d").alias("b"))
    return y.join(before, ["y", "sport_type"], "left").select("y", "sport_type", S.half_up(F.col("d"), 1).alias("d"), S.half_up(S.percent_change(F.col("d"), F.col("b")), 4).alias("change"))


@query(f"""WITH l AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem) SELECT {number('coalesce(corr(q, p), 0)', 6)} AS q_p, {number('coalesce(corr(q, d), 0)', 6)} AS q_d, {number('coalesce(corr(p, d), 0)', 6)} AS p_d FROM l""")
def correlation_matrix(spark, sf_dir):
    u = A.gear_uses(spark, sf_dir)
    pairs = (("km", "effort", "q_p"), ("km", "grade", "q_d"), ("effort", "grade", "p_d"))
    return u.agg(*[S.half_up(F.coalesce(F.corr(a, b), F.lit(0.0)), 6).alias(n) for a, b, n in pairs])


@query(f"WITH {A.GEAR_USES} SELECT gear_id, {number('regr_slope(effort, km)', 4)} AS slope, {number('regr_intercept(effort, km)', 3)} AS intercept FROM gear_use GROUP BY 1")
def linear_fit(spark, sf_dir):
    return A.gear_uses(spark, sf_dir).groupBy("gear_id").agg(S.half_up(F.regr_slope("effort", "km"), 4).alias("slope"), S.half_up(F.regr_intercept("effort", "km"), 3).alias("intercept"))


_SUMS = ", ".join(["count(*) AS n", *[f"sum(pow(x, {k})) AS s{k}" for k in range(1, 5)], *[f"sum(y * pow(x, {k})) AS t{k}" for k in range(3)]])
_DET = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
_det = lambda *v: _DET.format(**dict(zip("abcdefghi", v, strict=True)))
_WHOLE = _det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_FITS = (_det("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"), _det("n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), _det("n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2"))


@query(f"""WITH {A.GEAR_USES}, p AS (SELECT athlete_id, ln(km) AS x, effort AS y FROM gear_use WHERE km > 0), s AS (SELECT athlete_id, {_SUMS} FROM p GROUP BY 1)
SELECT athlete_id, n, {', '.join(f"CASE WHEN n >= 3 AND abs({_WHOLE}) > 1e-9 THEN {number(f'{top} / {_WHOLE}', 1)} END AS {c}" for c, top in zip("abc", _FITS, strict=True))} FROM s""")
def quadratic_log_fit(spark, sf_dir):
    fit = G.quadratic_in_log(A.gear_uses(spark, sf_dir), F.col("km"), F.col("effort"), ["athlete_id"])
    return fit.select("athlete_id", "n", *[S.half_up(F.col(c), 1).alias(c) for c in "abc"])


_MONTHLY = f"WITH {A.HISTORY}, m AS (SELECT sport_type, date_trunc('month', day)::DATE AS period, {number('sum(distance)', 2)} AS total FROM history GROUP BY 1, 2)"


@query(f"{_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY sport_type ORDER BY total, period) AS rn, greatest(1, count(*) OVER (PARTITION BY sport_type) // 5) AS size FROM m) SELECT sport_type, period, total, CAST(least((rn - 1) // size, 4) AS INTEGER) AS quintile FROM r")
def volume_quintiles(spark, sf_dir):
    m = A.history(spark, sf_dir).groupBy("sport_type", G.period_start(F.col("day"), "month").alias("period")).agg(S.half_up(F.sum("distance"), 2).alias("total"))
    return G.volume_quintiles(m, ["sport_type"])


@query(f"""WITH {A.HISTORY}, s AS (SELECT athlete_id, list(distance ORDER BY distance) AS v, count(*) AS n FROM history GROUP BY 1)
SELECT athlete_id, v[CAST(least(floor(n * CAST(0.8 AS DOUBLE)), n - 1) AS INTEGER) + 1] AS p80, v[CAST(floor((n - 1) * CAST(0.99 AS DOUBLE)) AS INTEGER) + 1] AS p99, v[CAST(floor((n - 1) * CAST(0.5 AS DOUBLE) + 0.5) AS INTEGER) + 1] AS p50,
  {number('v[CAST(floor((n - 1) * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1] + (v[CAST(ceil((n - 1) * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1] - v[CAST(floor((n - 1) * CAST(0.25 AS DOUBLE)) AS INTEGER) + 1]) * ((n - 1) * CAST(0.25 AS DOUBLE) - floor((n - 1) * CAST(0.25 AS DOUBLE)))', 4)} AS p25 FROM s""")
def percentile_rules(spark, sf_dir):
    by = {"p80": (0.8, "floor"), "p99": (0.99, "floor1"), "p50": (0.5, "nearest"), "p25": (0.25, "linear")}
    return G.percentiles(A.history(spark, sf_dir), ["athlete_id"], "distance", by).withColumn("p25", S.half_up(F.col("p25"), 4))


@query(f"""WITH {A.HISTORY}, m AS (SELECT date_trunc('month', day)::DATE AS period, count(*) AS n, avg(distance / moving_time) AS mean, stddev_pop(distance / moving_time) / avg(distance / moving_time) AS cv FROM history GROUP BY 1 HAVING count(*) >= 5)
SELECT period, n, {number('mean', 6)} AS mean, {number('cv', 6)} AS cv, {number('mean - lag(mean) OVER (ORDER BY period)', 6)} AS change FROM m""")
def cv_by_month(spark, sf_dir):
    v = F.col("distance") / F.col("moving_time")
    m = A.history(spark, sf_dir).groupBy(G.period_start(F.col("day"), "month").alias("period")).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), (F.stddev_pop(v) / F.avg(v)).alias("cv")).where("n >= 5")
    change = F.col("mean") - F.lag("mean").over(Window.orderBy("period"))  # a row a month: small whatever the table holds
    return m.select("period", "n", S.half_up(F.col("mean"), 6).alias("mean"), S.half_up(F.col("cv"), 6).alias("cv"), S.half_up(change, 6).alias("change"))


@query(f"""WITH {A.HISTORY}, p AS (SELECT athlete_id, date_trunc('year', day)::DATE AS period, sum(distance) AS d, count(*) AS n FROM history GROUP BY 1, 2) SELECT athlete_id, period, {number('sum(d) OVER w', 2)} AS distance, CAST(sum(n) OVER w AS BIGINT) AS n FROM p WINDOW w AS (PARTITION BY athlete_id ORDER BY period ROWS UNBOUNDED PRECEDING)""")
def point_in_time_totals(spark, sf_dir):
    out = joins.as_of_buckets(A.history(spark, sf_dir), "year", ["athlete_id"], {"distance": "distance"})
    return out.select("athlete_id", "period", S.half_up(F.col("distance"), 2).alias("distance"), "n")


@query(f"""WITH {A.HISTORY} SELECT CAST(year(day) AS INTEGER) AS y, sport_type, count(*) AS n, {number('sum(distance)', 0)} AS d FROM history GROUP BY ROLLUP (y, sport_type)""")
def rollup_year_sport(spark, sf_dir):
    return A.history(spark, sf_dir).rollup(F.year("day").alias("y"), "sport_type").agg(F.count("*").alias("n"), S.half_up(F.sum("distance"), 0).alias("d"))


@query(f"""WITH {A.HISTORY}, d AS (SELECT athlete_id, day, sport_type, sum(moving_time) AS t FROM history GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, day ORDER BY t DESC, sport_type) AS k, sum(t) OVER (PARTITION BY athlete_id, day) AS total FROM d)
SELECT athlete_id, day, sport_type AS main_sport, CAST(total AS BIGINT) AS seconds, {number('least(1, total / CAST(7200 AS DOUBLE))', 5)} AS intensity FROM r WHERE k = 1""")
def calendar_cells(spark, sf_dir):
    d = A.history(spark, sf_dir).groupBy("athlete_id", "day", "sport_type").agg(F.sum("moving_time").alias("t"))
    best = F.min_by("sport_type", F.struct(-F.col("t"), F.col("sport_type")))
    return d.groupBy("athlete_id", "day").agg(best.alias("main_sport"), F.sum("t").alias("seconds")).withColumn("intensity", S.half_up(F.least(F.lit(1.0), F.col("seconds") / 7200.0), 5))


@query(f"""WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events) SELECT k, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY 1""")
def inferred_columns(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", F.from_json("props", "map<string,string>").alias("extras"))
    return e.groupBy(F.col("extras")["k"].alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
