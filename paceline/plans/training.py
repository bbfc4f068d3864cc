"""Load, enrichment and readiness queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import load
from paceline.plans.base import number, query
from paceline.sources import adapters as A

ZONES = [(0.0, 120.0), (120.0, 140.0), (140.0, 160.0), (160.0, 175.0), (175.0, -1.0)]

def _mean(rows: int) -> str:
    over = f"OVER (PARTITION BY athlete_id ORDER BY day ROWS {rows} PRECEDING)"
    return f"CAST(sum(CAST(load AS DECIMAL(18,6))) {over} AS DOUBLE) / count(load) {over}"


RAMP = number("coalesce(ctl - lag(ctl) OVER (PARTITION BY athlete_id ORDER BY day), 0)", 1)
MODEL = f"model AS (SELECT *, {number('ctl - atl', 1)} AS tsb FROM (SELECT *, {_mean(6)} AS atl, {_mean(41)} AS ctl FROM daily))"
DAILY = f"daily AS (SELECT athlete_id, day, sum(distance) AS load, count(*) AS n FROM activity GROUP BY 1, 2), {MODEL}"


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.fitness_and_fatigue(load.daily_load(A.activities(spark, sf_dir), "distance"))


@query(f"""WITH {A.ACTIVITIES}, {DAILY}
SELECT athlete_id, day, n, {number('load', 3)} AS load, {number('atl', 3)} AS atl, {number('ctl', 3)} AS ctl, {number('tsb', 3)} AS tsb,
       {RAMP} AS ramp FROM model""")
def pmc_daily_load(spark, sf_dir):
    return model(spark, sf_dir).select("athlete_id", "day", "n", *[S.half_up(F.col(c), 3).alias(c) for c in ("load", "atl", "ctl", "tsb", "ramp")])


@query(f"""WITH {A.ACTIVITIES}, {DAILY}
SELECT a.id, {number('m.atl', 3)} AS atl, {number('m.ctl', 3)} AS ctl FROM activity a LEFT JOIN model m ON a.athlete_id = m.athlete_id AND a.day = m.day""")
def activity_with_model(spark, sf_dir):
    m = model(spark, sf_dir).select("athlete_id", "day", "atl", "ctl")
    return A.activities(spark, sf_dir).join(m, ["athlete_id", "day"], "left").select("id", S.half_up(F.col("atl"), 3).alias("atl"), S.half_up(F.col("ctl"), 3).alias("ctl"))


_MULT = "CASE sport_type WHEN 'Run' THEN 1.07 WHEN 'Ride' THEN 0.78 WHEN 'Swim' THEN 0.75 WHEN 'TrailRun' THEN 1.15 WHEN 'Workout' THEN 0.78 ELSE 0.80 END"


@query(f"""WITH {A.ACTIVITIES}, t AS (SELECT *, moving_time / CAST(3600 AS DOUBLE) AS h, CAST({_MULT} AS DOUBLE) AS m FROM activity)
SELECT id, {number('CASE WHEN average_heartrate > 0 THEN h * pow(average_heartrate / CAST(190 AS DOUBLE), 2) * 100 * m WHEN suffer_score > 0 THEN suffer_score * m ELSE h * 36 * m END', 2)} AS tss,
       CASE WHEN average_heartrate > 0 THEN 'heartrate' WHEN suffer_score > 0 THEN 'suffer_score' ELSE 'time' END AS tss_method FROM t""")
def tss_fallback(spark, sf_dir):
    return load.stress(A.activities(spark, sf_dir)).select("id", "tss", "tss_method")


@query(f"""WITH {A.ACTIVITIES}, z AS (SELECT * FROM (VALUES (0, 120, 0.40, 0.55, 120), (120, 140, 0.55, 0.72, 20), (140, 160, 0.72, 0.88, 20), (160, 175, 0.88, 1.05, 15), (175, 1000000, 1.05, 1.05, 20)) v(lo, hi, w, nx, width)),
t AS (SELECT a.*, moving_time / CAST(3600 AS DOUBLE) AS h, CAST({_MULT} AS DOUBLE) AS m, z.* FROM activity a JOIN z ON average_heartrate >= lo AND average_heartrate < hi)
SELECT id, {number('h * (CAST(w AS DOUBLE) + (average_heartrate - lo) / CAST(width AS DOUBLE) * CAST(nx - w AS DOUBLE)) * 100 * m', 2)} AS tss FROM t""")
def tss_by_zones(spark, sf_dir):
    return load.stress(A.activities(spark, sf_dir), ZONES).where("tss_method = 'heartrate_zones'").select("id", "tss")


@query(f"""WITH {A.ACTIVITIES}, t AS (SELECT *, CASE WHEN sport_type IN ('Run', 'TrailRun') THEN moving_time / CAST(60 AS DOUBLE) / (distance / 1000) / average_heartrate
  WHEN sport_type = 'Swim' THEN moving_time / CAST(60 AS DOUBLE) / (distance / 100) / average_heartrate WHEN sport_type = 'Ride' THEN distance / 1000 / (moving_time / CAST(3600 AS DOUBLE)) / average_heartrate END AS e
  FROM activity WHERE average_heartrate > 0 AND distance > 0)
SELECT sport_type, count(e) AS n, {number('avg(e)', 6)} AS mean_efficiency FROM t GROUP BY 1""")
def efficiency_by_sport(spark, sf_dir):
    e = load.efficiency(A.activities(spark, sf_dir)).where("average_heartrate > 0 and distance > 0")
    return e.groupBy("sport_type").agg(F.count("efficiency").alias("n"), S.half_up(F.avg("efficiency"), 6).alias("mean_efficiency"))


@query(f"""WITH {A.ACTIVITIES}, t AS (SELECT id, sport_type, moving_time, average_heartrate, distance / moving_time * 60 AS v FROM activity WHERE distance <> 0 AND moving_time >= 600 AND sport_type = 'Run'),
u AS (SELECT id, (CAST(-4.60 AS DOUBLE) + CAST(0.182258 AS DOUBLE) * v + CAST(0.000104 AS DOUBLE) * v * v) / coalesce(average_heartrate / CAST(190 AS DOUBLE), CAST(0.8 AS DOUBLE)) AS x FROM t)
SELECT id, {number('x', 4)} AS vo2max FROM u WHERE x > 25 AND x < 90""")
def vo2max_runs(spark, sf_dir):
    return load.vo2max(A.activities(spark, sf_dir)).where("vo2max is not null").select("id", S.half_up(F.col("vo2max"), 4).alias("vo2max"))


_SPORT_RECOVERY = "CASE sport_type WHEN 'Run' THEN 1.2 WHEN 'TrailRun' THEN 1.5 WHEN 'Ride' THEN 0.9 WHEN 'Swim' THEN 0.7 WHEN 'Workout' THEN 0.8 ELSE 1.0 END"
RECOVERY_SQL = f"""t AS (SELECT *, moving_time / CAST(3600 AS DOUBLE) AS h, CAST({_MULT} AS DOUBLE) AS m, average_heartrate / CAST(190 AS DOUBLE) AS p FROM activity),
u AS (SELECT *, {number('CASE WHEN average_heartrate > 0 THEN h * p * p * 100 * m WHEN suffer_score > 0 THEN suffer_score * m ELSE h * 36 * m END', 2)} AS tss FROM t),
rec AS (SELECT id, athlete_id, day, CAST(floor(least(greatest(coalesce(nullif(tss, 0), 30) * CAST({_SPORT_RECOVERY} AS DOUBLE) * CAST(CASE WHEN p IS NULL THEN 1.0 WHEN p < 0.6 THEN 0.6 WHEN p < 0.7 THEN 0.85 WHEN p < 0.8 THEN 1.0 WHEN p < 0.9 THEN 1.25 ELSE 1.5 END AS DOUBLE) * sqrt(h) / 10, 4), 96) + 0.5) AS INTEGER) AS recovery_hours FROM u)"""


@query(f"WITH {A.ACTIVITIES}, {RECOVERY_SQL} SELECT id, recovery_hours FROM rec")
def recovery_hours(spark, sf_dir):
    return load.recovery(load.stress(A.activities(spark, sf_dir))).select("id", "recovery_hours")


@query(f"""WITH {A.ACTIVITIES}, {RECOVERY_SQL}, m AS (SELECT *, max(recovery_hours) OVER (PARTITION BY athlete_id, day) AS top FROM rec),
d AS (SELECT athlete_id, day, count(*) AS n, max(top) AS top, sum(CASE WHEN recovery_hours <> top THEN recovery_hours ELSE 0 END) AS rest FROM m GROUP BY 1, 2)
SELECT athlete_id, day, CAST(CASE WHEN n = 1 THEN top ELSE floor(least((top * CAST(0.7 AS DOUBLE) + rest * CAST(0.3 AS DOUBLE)) * (1 + (n - 1) * CAST(0.12 AS DOUBLE)), 96) + 0.5) END AS INTEGER) AS recovery_hours FROM d""")
def recovery_by_day(spark, sf_dir):
    return load.daily_recovery(load.recovery(load.stress(A.activities(spark, sf_dir))))


SEVEN = """ends AS (SELECT athlete_id, min(day) AS lo, max(day) AS hi FROM model GROUP BY 1),
spine AS (SELECT athlete_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
seven AS (SELECT s.athlete_id, s.day, sum(coalesce(m.load, 0)) OVER w AS load7, last_value(m.ctl IGNORE NULLS) OVER c AS ctl, last_value(m.atl IGNORE NULLS) OVER c AS atl, last_value(m.tsb IGNORE NULLS) OVER c AS tsb
  FROM spine s LEFT JOIN model m ON s.athlete_id = m.athlete_id AND s.day = m.day
  WINDOW w AS (PARTITION BY s.athlete_id ORDER BY s.day ROWS 6 PRECEDING), c AS (PARTITION BY s.athlete_id ORDER BY s.day ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {A.ACTIVITIES}, {DAILY}, {SEVEN} SELECT athlete_id, day, {number('load7', 3)} AS load7, {number('atl', 3)} AS atl, {number('ctl', 3)} AS ctl FROM seven")
def seven_day_load_carry_forward(spark, sf_dir):
    return load.seven_day_load(model(spark, sf_dir)).select("athlete_id", "day", *[S.half_up(F.col(c), 3).alias(c) for c in ("load7", "atl", "ctl")])


STABILITY = "CASE WHEN base <= 0 THEN CAST(0.65 AS DOUBLE) WHEN r >= 0.9 AND r <= 1.3 THEN 1 WHEN r < 0.9 THEN greatest(CAST(0.58 AS DOUBLE), CAST(0.88 AS DOUBLE) - (CAST(0.9 AS DOUBLE) - r) * CAST(0.6 AS DOUBLE)) WHEN r > 1.4 THEN greatest(0, CAST(0.72 AS DOUBLE) - (r - CAST(1.4 AS DOUBLE)) * CAST(0.9 AS DOUBLE)) ELSE CAST(0.82 AS DOUBLE) END"


@query(f"""WITH {A.ACTIVITIES}, {DAILY}, {SEVEN}, b AS (SELECT *, avg(load7) OVER (PARTITION BY athlete_id ORDER BY day ROWS 27 PRECEDING) AS base FROM seven), r AS (SELECT *, load7 / base AS r FROM b)
SELECT athlete_id, day, {number('base', 3)} AS baseline, {number(STABILITY, 5)} AS stability FROM r""")
def load_stability(spark, sf_dir):
    return load.stability(load.seven_day_load(model(spark, sf_dir))).select("athlete_id", "day", S.half_up(F.col("baseline"), 3).alias("baseline"), S.half_up(F.col("stability"), 5).alias("stability"))


RAW_RISK = "least(greatest((CAST(0.6 AS DOUBLE) * pow(tired, CAST(1.5 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * pow(rp, CAST(1.3 AS DOUBLE)) * tired + CAST(0.15 AS DOUBLE) * pow(ap, CAST(1.2 AS DOUBLE))) * CASE WHEN n7 > 1 AND m7 > 0 THEN 1 + least(s7 / m7, 1) * CAST(0.3 AS DOUBLE) ELSE 1 END, 0), 1)"
FRAMES = f"""m AS (SELECT *, {RAMP} AS ramp FROM model),
f AS (SELECT *, list(tsb) OVER (PARTITION BY athlete_id ORDER BY day ROWS 42 PRECEDING) AS t, list(ramp) OVER (PARTITION BY athlete_id ORDER BY day ROWS 14 PRECEDING) AS r, list(atl) OVER (PARTITION BY athlete_id ORDER BY day ROWS 7 PRECEDING) AS al,
  avg(load) OVER w AS m7, stddev_pop(load) OVER w AS s7, count(load) OVER w AS n7 FROM m WINDOW w AS (PARTITION BY athlete_id ORDER BY day ROWS 6 PRECEDING)),
p AS (SELECT *, 1 - len(list_filter(t, lambda x: x <= tsb)) / CAST(len(t) AS DOUBLE) AS tired, len(list_filter(r, lambda x: x <= ramp)) / CAST(len(r) AS DOUBLE) AS rp, len(list_filter(al, lambda x: x <= atl)) / CAST(len(al) AS DOUBLE) AS ap FROM f)"""


@query(f"""WITH RECURSIVE {A.ACTIVITIES}, {DAILY}, {FRAMES}, o AS (SELECT athlete_id, day, {RAW_RISK} AS x, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k FROM p),
e AS (SELECT athlete_id, day, k, x AS risk FROM o WHERE k = 1 UNION ALL SELECT o.athlete_id, o.day, o.k, floor((e.risk * (1 - (CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * least(1, abs(x - risk)))) + x * (CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * least(1, abs(x - risk)))) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 FROM e JOIN o ON e.athlete_id = o.athlete_id AND o.k = e.k + 1)
SELECT athlete_id, day, {number('risk', 3)} AS risk FROM e""")
def risk_smoothed(spark, sf_dir):
    return load.risk(model(spark, sf_dir)).withColumn("risk", S.half_up(F.col("risk"), 3))


@query(f"""WITH {A.ACTIVITIES}, {DAILY}, {FRAMES} SELECT athlete_id, day, {number(RAW_RISK, 5)} AS raw_risk FROM p""")
def risk_by_frame_ranks(spark, sf_dir):
    return load.raw_risk(model(spark, sf_dir)).select("athlete_id", "day", S.half_up(F.col("raw_risk"), 5).alias("raw_risk"))


@query(f"""WITH RECURSIVE {A.ACTIVITIES}, {DAILY}, n AS (SELECT athlete_id, day, load, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k FROM daily),
e AS (SELECT athlete_id, day, k, load / CAST(7 AS DOUBLE) AS ema FROM n WHERE k = 1 UNION ALL SELECT n.athlete_id, n.day, n.k, e.ema + (n.load - e.ema) / CAST(7 AS DOUBLE) FROM e JOIN n ON e.athlete_id = n.athlete_id AND n.k = e.k + 1)
SELECT athlete_id, day, {number('ema', 3)} AS ema7 FROM e""")
def ema_fold(spark, sf_dir):
    daily = load.daily_load(A.activities(spark, sf_dir), "distance")
    return load.exponential(daily, "load", 7, "ema7").select("athlete_id", "day", S.half_up(F.col("ema7"), 3).alias("ema7"))


_FORM = "CASE WHEN tsb >= 15 THEN 1 WHEN tsb >= 5 THEN 0.92 WHEN tsb >= -5 THEN 0.74 WHEN tsb >= -15 THEN 0.56 WHEN tsb >= -30 THEN 0.36 ELSE 0.16 END"
_TIRED = "CASE WHEN atl - ctl <= -6 THEN 0.22 WHEN atl - ctl <= 4 THEN 0.34 WHEN atl - ctl <= 12 THEN 0.56 WHEN atl - ctl <= 22 THEN 0.80 ELSE 1 END"


def _readiness(hrv: bool) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    away = lambda v: f"CASE WHEN {v} < reference_low THEN reference_low - {v} WHEN {v} > reference_high THEN {v} - reference_high ELSE 0 END"
    part = lambda v, share, plus: f"CASE WHEN {away(v)} = 0 THEN 1 ELSE greatest({d(0.1)}, 1 - {away(v)} / (wide * {d(share)} + {plus})) END"
    score = f"least(1, greatest(0, {part('avg7', 0.9, 8)} * {d(0.5)} + {part('nightly', 0.75, 6)} * {d(0.35)} + greatest({d(0.35)}, 1 - abs(nightly - avg7) / (wide + 10)) * {d(0.15)}))"
    told = f"{A.HRV}, hs AS (SELECT athlete_id, day, {score} AS hrv FROM (SELECT athlete_id, day, nightly, coalesce(avg7, nightly) AS avg7, reference_low, reference_high, greatest(6, reference_high - reference_low) AS wide FROM hrv WHERE nightly IS NOT NULL))" if hrv else "hs AS (SELECT NULL::BIGINT AS athlete_id, NULL::DATE AS day, NULL::DOUBLE AS hrv)"
    return f"""WITH RECURSIVE {A.ACTIVITIES}, {DAILY}, {SEVEN}, {told}, b AS (SELECT *, avg(load7) OVER (PARTITION BY athlete_id ORDER BY day ROWS 27 PRECEDING) AS base, greatest(ctl * 7, 10) AS week, cume_dist() OVER (PARTITION BY athlete_id ORDER BY {number('ctl', 6)}) AS rank FROM seven),
w AS (SELECT *, load7 / base AS r, greatest(0, (week * {d(0.75)} + week * {d(1.3)}) / 2 - greatest(week * {d(1.3)} - week * {d(0.75)}, 30) / 2) AS lo, (week * {d(0.75)} + week * {d(1.3)}) / 2 + greatest(week * {d(1.3)} - week * {d(0.75)}, 30) / 2 AS hi FROM b),
p AS (SELECT athlete_id, day, CAST({_FORM} AS DOUBLE) AS form, least(1, greatest(0, {d(0.25)} + rank * {d(0.9)})) AS fitness, 1 - CAST({_TIRED} AS DOUBLE) AS fresh, {STABILITY} AS st, CASE WHEN load7 < lo THEN greatest({d(0.28)}, 1 - (lo - load7) / (greatest(1, hi - lo) * {d(0.95)} + 12)) WHEN load7 > hi THEN greatest(0, 1 - (load7 - hi) / (greatest(1, hi - lo) * {d(0.7)} + 10)) ELSE 1 END AS bs FROM w),
q AS (SELECT p.*, least(1, greatest(0, st * {d(0.65)} + bs * {d(0.35)})) AS load_score, hrv FROM p LEFT JOIN hs ON hs.athlete_id = p.athlete_id AND hs.day = p.day),
s AS (SELECT *, 100 * CASE WHEN hrv IS NULL THEN {d(0.35)} * form + {d(0.25)} * fitness + {d(0.2)} * fresh + {d(0.2)} * load_score ELSE {d(0.3)} * form + {d(0.22)} * fitness + {d(0.18)} * fresh + {d(0.15)} * load_score + {d(0.15)} * hrv END AS blend FROM q),
c AS (SELECT athlete_id, day, avg(blend) OVER (PARTITION BY athlete_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x, row_number() OVER (PARTITION BY athlete_id ORDER BY day) AS k FROM s),
e AS (SELECT athlete_id, day, k, x AS v FROM c WHERE k = 1 UNION ALL SELECT c.athlete_id, c.day, c.k, e.v + greatest(-8, least(8, c.x - e.v)) FROM e JOIN c ON e.athlete_id = c.athlete_id AND c.k = e.k + 1)"""


@query(_readiness(False) + f" SELECT athlete_id, day, {number('v', 3)} AS readiness FROM e")
def readiness_slew(spark, sf_dir):
    return load.readiness(load.stability(load.seven_day_load(model(spark, sf_dir)))).withColumn("readiness", S.half_up(F.col("readiness"), 3))


@query(_readiness(True) + f" SELECT athlete_id, day, {number('v', 3)} AS readiness FROM e")
def readiness_with_hrv(spark, sf_dir):
    dense = load.stability(load.seven_day_load(model(spark, sf_dir)))
    return load.readiness(dense, A.hrv(spark, sf_dir)).withColumn("readiness", S.half_up(F.col("readiness"), 3))


@query(_readiness(True) + f" SELECT athlete_id, day, {', '.join(number(c, 4) + ' AS ' + n for c, n in (('form', 'form'), ('fitness', 'fitness'), ('fresh', 'freshness'), ('load_score', 'load_score'), ('hrv', 'hrv'), ('blend', 'blend')))} FROM s")
def readiness_breakdown(spark, sf_dir):
    told = load.readiness_scores(load.stability(load.seven_day_load(model(spark, sf_dir))), A.hrv(spark, sf_dir))
    return told.select("athlete_id", "day", *[S.half_up(F.col(c), 4).alias(c) for c in ("form", "fitness", "freshness", "load_score", "hrv", "blend")])


@query(f"""WITH w AS (SELECT event_id AS id, CAST(event_id % 45 - 5 AS DOUBLE) AS t, CAST(event_id % 101 AS DOUBLE) AS h, value / 10 AS wind, CAST(event_id % 7 AS DOUBLE) AS rain, CAST(990 + event_id % 50 AS DOUBLE) AS p FROM events)
SELECT id, CAST(least(floor(least(40, (t - 15) * (t - 15) / CAST(15.625 AS DOUBLE)) + CASE WHEN h > 50 THEN least(25, (h - 50) / 50 * 15 + CASE WHEN t > 20 THEN (t - 20) / 20 * ((h - 50) / 50) * 10 ELSE 0 END) ELSE 0 END
  + least(20, wind / 30 * 20) + least(10, rain * 2) + least(5, abs(p - 1013) / 40 * 5) + 0.5), 100) AS INTEGER) AS difficulty FROM w""")
def env_difficulty(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 45 - 5).cast("double").alias("temperature"), (F.col("event_id") % 101).cast("double").alias("humidity"), (F.col("value") / 10).alias("wind_speed"), (F.col("event_id") % 7).cast("double").alias("precipitation"), (990 + F.col("event_id") % 50).cast("double").alias("pressure"))
    from paceline.operators.enrich import environment

    return environment(e).select("id", "difficulty")
