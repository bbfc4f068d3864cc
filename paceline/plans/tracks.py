"""Sample-level queries over one track per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import points as P
from paceline.operators import predict, routes
from paceline.plans.base import exact, number, query
from paceline.sources import adapters as A

STEPS = """d AS (SELECT *, coalesce(elevation - lag(elevation) OVER o, 0) AS climb, CAST(coalesce(epoch_us(ts) // 1000000 - epoch_us(lag(ts) OVER o) // 1000000, 0) AS BIGINT) AS d_time FROM point WINDOW o AS (PARTITION BY activity_id ORDER BY idx)),
k AS (SELECT *, sum(step_m) OVER r / 1000 AS km, sum(greatest(climb, 0)) OVER r AS gain, sum(greatest(-climb, 0)) OVER r AS loss FROM d WINDOW r AS (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {A.POINTS}, {STEPS} SELECT activity_id, CAST(idx AS INTEGER) AS idx, d_time, {number('km', 4)} AS km, {number('gain', 4)} AS gain, {number('loss', 4)} AS loss FROM k")
def point_deltas(spark, sf_dir):
    return P.deltas(A.points(spark, sf_dir)).select("activity_id", "idx", "d_time", *[S.half_up(F.col(c), 4).alias(c) for c in ("km", "gain", "loss")])


@query(f"""WITH {A.POINTS} SELECT CASE WHEN abs(grade) > 8 THEN 'technical' WHEN grade > 2 THEN 'climb' WHEN grade < -2 THEN 'descent' ELSE 'flat' END AS terrain, count(*) AS n, {number(exact('speed'), 4)} AS speed FROM point GROUP BY 1""")
def terrain_summary(spark, sf_dir):
    return A.points(spark, sf_dir).groupBy(P.terrain(F.col("grade")).alias("terrain")).agg(F.count("*").alias("n"), S.half_up(S.exact_mean(F.col("speed")), 4).alias("speed"))


def _islands(inside: str, source: str) -> str:
    return f"f AS (SELECT *, {inside} AS here, CASE WHEN {inside} AND NOT coalesce(lag({inside}) OVER (PARTITION BY activity_id ORDER BY idx), false) THEN 1 ELSE 0 END AS st FROM {source}), i AS (SELECT *, sum(st) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM f)"


@query(f"""WITH {A.POINTS}, {STEPS}, {_islands('(grade >= 1 AND moving)', 'k')}, c AS (SELECT activity_id, island, min(idx) AS s, max(idx) AS e, min(km) AS a, max(km) AS b, sum(greatest(climb, 0)) AS g FROM i WHERE here GROUP BY 1, 2),
v AS (SELECT *, b - a AS km FROM c WHERE b - a >= CAST(0.01 AS DOUBLE) AND g >= 1 AND g / ((b - a) * 1000) * 100 >= 1), x AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY activity_id ORDER BY s) <= CAST(0.02 AS DOUBLE) THEN 0 ELSE 1 END AS far FROM v),
y AS (SELECT *, sum(far) OVER (PARTITION BY activity_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS n FROM x)
SELECT activity_id, CAST(min(s) AS INTEGER) AS start_idx, CAST(max(e) AS INTEGER) AS end_idx, {number('sum(km)', 4)} AS km, {number('sum(g)', 4)} AS gain FROM y GROUP BY activity_id, n""")
def islands_climbs(spark, sf_dir):
    c = P.climbs(A.points(spark, sf_dir), min_grade=1.0, min_km=0.01, min_gain=1.0, merge_km=0.02)
    return c.select("activity_id", "start_idx", "end_idx", S.half_up(F.col("km"), 4).alias("km"), S.half_up(F.col("gain"), 4).alias("gain"))


@query(f"""WITH {A.POINTS}, {STEPS}, {_islands('(speed < 40 AND NOT moving)', 'k')} SELECT activity_id, CAST(min(idx) AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, CAST(sum(d_time) AS BIGINT) AS seconds FROM i WHERE here GROUP BY activity_id, island HAVING sum(d_time) >= 5""")
def islands_stops(spark, sf_dir):
    return P.stops(A.points(spark, sf_dir), below=40.0)


@query(f"""WITH {A.POINTS}, {STEPS}, s AS (SELECT *, floor(km / CAST(0.05 AS DOUBLE)) AS split FROM k) SELECT activity_id, CAST(split AS BIGINT) AS split, count(*) AS n, {number(exact('speed'), 4)} AS avg_speed, {number('sum(greatest(climb, 0))', 4)} AS gain FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def splits_by_distance(spark, sf_dir):
    own = P.deltas(A.points(spark, sf_dir)).withColumn("split", F.floor(F.col("km") / 0.05))
    return own.groupBy("activity_id", "split").agg(F.count("*").alias("n"), S.half_up(S.exact_mean(F.col("speed")), 4).alias("avg_speed"), S.half_up(F.sum(F.greatest("climb", F.lit(0.0))), 4).alias("gain")).where("n >= 2")


@query(f"""WITH {A.POINTS}, {STEPS}, e AS (SELECT *, {number('km * 1000', 3)} AS m FROM k), f AS (SELECT *, CAST(floor(m / 50) AS BIGINT) AS s, m = floor(m / 50) * 50 AS edge FROM e), b AS (SELECT *, s AS split FROM f UNION ALL SELECT *, s - 1 FROM f WHERE edge AND s > 0)
SELECT activity_id, split, count(*) AS n, {number('max(km) - min(km)', 5)} AS km, {number(exact('speed'), 4)} AS avg_speed, {number(exact('heart_rate'), 4)} AS avg_hr, {number('sum(greatest(climb, 0))', 3)} AS gain FROM b GROUP BY 1, 2 HAVING count(*) >= 2""")
def splits_inclusive(spark, sf_dir):
    s = P.splits(A.points(spark, sf_dir), km=0.05)
    return s.select("activity_id", "split", "n", *[S.half_up(F.col(c), d).alias(c) for c, d in (("km", 5), ("avg_speed", 4), ("avg_hr", 4), ("gain", 3))])


@query(f"""WITH {A.POINTS}, s AS (SELECT activity_id, idx, count(*) OVER (PARTITION BY activity_id) AS n, sum(power) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM point),
l AS (SELECT activity_id, idx, n, s, {', '.join(f'coalesce(lag(s, {d}) OVER (PARTITION BY activity_id ORDER BY idx), 0) AS l{d}' for d in P.DURATIONS)} FROM s),
c AS (SELECT activity_id, {', '.join(f"CAST({number(f'max(CASE WHEN idx >= {d - 1} THEN (s - l{d}) / CAST({d} AS DOUBLE) END)', 0)} AS INTEGER) AS best_{d}" for d in P.DURATIONS)} FROM l GROUP BY 1)
SELECT *, CAST(floor(best_1200 * CAST(0.95 AS DOUBLE) + 0.5) AS INTEGER) AS ftp FROM c""")
def power_curve_prefix(spark, sf_dir):
    return P.power_curve(A.points(spark, sf_dir)).withColumns({f"best_{d}": S.half_up(F.col(f"best_{d}")).cast("int") for d in P.DURATIONS})


@query(f"""WITH {A.POINTS}, m AS (SELECT activity_id, power, CASE WHEN row_number() OVER w >= 30 THEN pow(avg(power) OVER (PARTITION BY activity_id ORDER BY idx ROWS 29 PRECEDING), 4) END AS p4 FROM point WHERE power >= 0 WINDOW w AS (PARTITION BY activity_id ORDER BY idx))
SELECT activity_id, CAST({number('pow(avg(p4), CAST(0.25 AS DOUBLE))', 0)} AS INTEGER) AS np, {number('CASE WHEN count(*) FILTER (power > 0) < 30 THEN avg(power) FILTER (power > 0) ELSE pow(avg(pow(power, 4)) FILTER (power > 0), CAST(0.25 AS DOUBLE)) END', 4)} AS p4_mean FROM m GROUP BY 1""")
def normalised_power(spark, sf_dir):
    return P.normalised_power(A.points(spark, sf_dir)).withColumn("p4_mean", S.half_up(F.col("p4_mean"), 4))


@query(f"""WITH {A.POINTS}, m AS (SELECT activity_id, idx, power, count(*) OVER (PARTITION BY activity_id) AS n, avg(CASE WHEN power > 0 THEN power END) OVER (PARTITION BY activity_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS ahead FROM point)
SELECT activity_id, {number('coalesce(pow(avg(pow(ahead, 4)) FILTER (idx < n - 30), CAST(0.25 AS DOUBLE)), avg(power) FILTER (power > 0))', 4)} AS np FROM m GROUP BY 1""")
def normalised_power_ahead(spark, sf_dir):
    return P.normalised_power_ahead(A.points(spark, sf_dir)).withColumn("np", S.half_up(F.col("np"), 4))


@query(f"""WITH {A.POINTS}, n AS (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n FROM point), q AS (SELECT activity_id, avg(heart_rate) FILTER (idx < n // 4) AS a, avg(heart_rate) FILTER (idx >= n - n // 4) AS b FROM n GROUP BY 1) SELECT activity_id, {number('(b - a) / a * 100', 4)} AS drift_pct FROM q""")
def heart_rate_drift(spark, sf_dir):
    return P.drift(A.points(spark, sf_dir)).select("activity_id", S.half_up(F.col("drift_pct"), 4).alias("drift_pct"))


#: The signs at each sample, every pair of windows gathered by a join.
SIGNS = f"""{STEPS}, n AS (SELECT *, CASE WHEN moving AND speed > 0 THEN 60 / speed END AS pace, count(*) OVER (PARTITION BY activity_id) AS n, CAST(floor(count(*) OVER (PARTITION BY activity_id) * CAST(0.1 AS DOUBLE)) AS INTEGER) AS w FROM k),
m AS (SELECT a.activity_id, a.idx, a.n, a.km, a.ts, {', '.join(f"avg(b.{v}) FILTER (b.idx < a.idx AND b.{v} > 0) AS {c}1, avg(b.{v}) FILTER (b.idx >= a.idx AND b.{v} > 0) AS {c}2" for v, c in (('pace', 'x'), ('heart_rate', 'h'), ('cadence', 'c'), ('power', 'p')))}
  FROM n a JOIN n b ON a.activity_id = b.activity_id AND b.idx >= a.idx - a.w AND b.idx < a.idx + a.w WHERE a.w > 0 AND a.idx >= a.w GROUP BY ALL),
g AS (SELECT *, coalesce((x2 - x1) / x1 > CAST(0.1 AS DOUBLE), false) AS pace_drop, coalesce((h2 - h1) / h1 > CAST(0.05 AS DOUBLE), false) AS hr_rise, coalesce((c1 - c2) / c1 > CAST(0.08 AS DOUBLE), false) AS cadence_drop, coalesce((p1 - p2) / p1 > CAST(0.08 AS DOUBLE), false) AS power_drop FROM m),
s AS (SELECT *, least(CAST(1 AS DOUBLE), (CAST(pace_drop AS INTEGER) + CAST(hr_rise AS INTEGER) + CAST(cadence_drop AS INTEGER) + CAST(power_drop AS INTEGER)) * CAST(0.3 AS DOUBLE)) AS severity FROM g)"""


@query(f"WITH {A.POINTS}, {SIGNS} SELECT activity_id, CAST(idx AS INTEGER) AS idx, pace_drop, hr_rise, cadence_drop, power_drop, {number('severity', 2)} AS severity FROM s")
def fatigue_signals(spark, sf_dir):
    return P.fatigue(A.points(spark, sf_dir)).withColumn("severity", S.half_up(F.col("severity"), 2))


#: A row for each activity, as ``points.fatigue_summary``.
FATIGUE = f"""{SIGNS}, fe AS (SELECT * FROM s WHERE severity > CAST(0.5 AS DOUBLE)), fb AS (SELECT activity_id, count(*) AS size, min(ts) AS t0 FROM k GROUP BY 1),
fa AS (SELECT activity_id, count(*) AS events, min(idx) AS onset_idx, arg_min(km, idx) AS onset_km, arg_min(ts, idx) AS t, arg_min(severity, idx) AS severity, avg(severity) AS mean FROM fe GROUP BY 1),
fatigued AS (SELECT fb.activity_id, events IS NOT NULL AS detected, CAST(onset_idx AS INTEGER) AS onset_idx, {number('onset_km', 4)} AS onset_km, epoch_us(t) // 1000000 - epoch_us(t0) // 1000000 AS onset_seconds, {number('coalesce(severity, 0)', 2)} AS severity,
  CAST(coalesce(events, 0) AS INTEGER) AS events, CAST(coalesce(floor(floor(events / CAST(size AS DOUBLE) * mean * CAST(100000000 AS DOUBLE) + 0.5) / 1000000 + 0.5), 0) AS INTEGER) AS index FROM fb LEFT JOIN fa ON fb.activity_id = fa.activity_id)"""


@query(f"WITH {A.POINTS}, {FATIGUE} SELECT * FROM fatigued")
def fatigue_summary(spark, sf_dir):
    return P.fatigue_summary(A.points(spark, sf_dir)).withColumns({"onset_km": S.half_up(F.col("onset_km"), 4), "severity": S.half_up(F.col("severity"), 2)})


@query()
def hampel_inplace(spark, sf_dir):
    return P.cleaned(A.points(spark, sf_dir)).select("activity_id", "idx", "elevation_clean", "grade_smooth")


@query(f"""WITH {A.POINTS}, {STEPS}, t AS (SELECT *, max(km) OVER (PARTITION BY activity_id) AS top FROM k), c AS (SELECT activity_id, CAST(least(floor(km / top * 40), 39) AS INTEGER) AS band, {exact('speed')} AS mean FROM t WHERE top > 0 GROUP BY 1, 2),
e AS (SELECT DISTINCT activity_id, CAST(b.range AS INTEGER) AS band FROM c, range(40) b) SELECT e.activity_id, e.band, {number('last_value(mean IGNORE NULLS) OVER (PARTITION BY e.activity_id ORDER BY e.band ROWS UNBOUNDED PRECEDING)', 4)} AS mean FROM e LEFT JOIN c ON e.activity_id = c.activity_id AND e.band = c.band""")
def distance_bands(spark, sf_dir):
    return P.bands(A.points(spark, sf_dir)).select("activity_id", "band", S.half_up(F.col("mean"), 4).alias("mean"))


@query(f"""WITH {A.POINTS}, v AS (SELECT activity_id, idx, CAST(power AS BIGINT) % 32 AS c FROM point), d AS (SELECT activity_id, idx, CASE WHEN c % 2 = 1 THEN -((c + 1) // 2) ELSE c // 2 END AS d FROM v), s AS (SELECT activity_id, idx // 2 AS k, sum(d) FILTER (idx % 2 = 0) AS a, sum(d) FILTER (idx % 2 = 1) AS b FROM d GROUP BY 1, 2)
SELECT activity_id, CAST(k AS INTEGER) AS k, CAST(sum(a) OVER w AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat, CAST(sum(b) OVER w AS DOUBLE) / CAST(100000 AS DOUBLE) AS lon FROM s WHERE b IS NOT NULL WINDOW w AS (PARTITION BY activity_id ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def polyline_decode(spark, sf_dir):
    code = F.char(63 + F.col("power").cast("long") % 32)
    drawn = A.points(spark, sf_dir).groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", code.alias("c")))), lambda s: s["c"]), "").alias("line"))
    return drawn.select("activity_id", F.posexplode(S.decoded_polyline(F.col("line"))).alias("k", "p")).select("activity_id", "k", "p.lat", "p.lon")


_COST = "(CAST(-4.60 AS DOUBLE) + CAST(0.182258 AS DOUBLE) * ({m} / {t}) + CAST(0.000104 AS DOUBLE) * ({m} / {t}) * ({m} / {t})) / (CAST(0.8 AS DOUBLE) + CAST(0.1894393 AS DOUBLE) * exp(CAST(-0.012778 AS DOUBLE) * {t}) + CAST(0.2989558 AS DOUBLE) * exp(CAST(-0.1932605 AS DOUBLE) * {t}))"
_MISS, _NEXT = (f"({_COST.format(m='target', t=t)} - vdot)" for t in ("t", "(t + CAST(0.001 AS DOUBLE))"))
_SLOPE = f"(({_NEXT} - {_MISS}) / CAST(0.001 AS DOUBLE))"


@query(f"""WITH RECURSIVE {A.HISTORY}, s AS (SELECT athlete_id, id, {_COST.format(m='distance', t='(moving_time / CAST(60 AS DOUBLE))')} AS v FROM history WHERE distance >= 3000 AND moving_time > 0), r AS (SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY v DESC, id) AS k FROM s WHERE v > 10 AND v < 100),
b AS (SELECT athlete_id, avg(v) AS vdot FROM r WHERE k <= 5 GROUP BY 1), g AS (SELECT * FROM (VALUES (CAST(5000 AS DOUBLE)), (10000), (21097), (42195)) x(target)),
n AS (SELECT athlete_id, target, vdot, target / CAST(1000 AS DOUBLE) * CAST(4.5 AS DOUBLE) AS t, 0 AS k FROM b, g UNION ALL SELECT athlete_id, target, vdot, CASE WHEN abs({_SLOPE}) < 1e-10 THEN t ELSE greatest(CAST(0.1 AS DOUBLE), t - {_MISS} / {_SLOPE}) END, k + 1 FROM n WHERE k < 50)
SELECT athlete_id, target, {number('t * 60', 1)} AS seconds FROM n WHERE k = 50""")
def vdot_prediction(spark, sf_dir):
    v = predict.estimated_vdot(A.history(spark, sf_dir), ["athlete_id"])
    return v.withColumn("target", F.explode(F.array(*map(F.lit, (5000.0, 10000.0, 21097.0, 42195.0))))).select("athlete_id", "target", S.half_up(S.vdot_time(F.col("vdot"), F.col("target")), 1).alias("seconds"))


@query(f"""WITH {A.POINTS}, v AS (SELECT activity_id, idx, CAST(power AS BIGINT) % 32 AS c FROM point), d AS (SELECT activity_id, idx, CASE WHEN c % 2 = 1 THEN -((c + 1) // 2) ELSE c // 2 END AS d FROM v), s AS (SELECT activity_id, idx // 2 AS k, sum(d) FILTER (idx % 2 = 0) AS a, sum(d) FILTER (idx % 2 = 1) AS b FROM d GROUP BY 1, 2),
x AS (SELECT activity_id, k, CAST(sum(a) OVER w AS DOUBLE) / CAST(100000 AS DOUBLE) AS lat, CAST(sum(b) OVER w AS DOUBLE) / CAST(100000 AS DOUBLE) AS lon FROM s WHERE b IS NOT NULL WINDOW w AS (PARTITION BY activity_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
e AS (SELECT x.*, coalesce(lead(lat) OVER o, lat) AS lat2, coalesce(lead(lon) OVER o, lon) AS lon2, coalesce(lag(lat) OVER o, lat) AS lat0, coalesce(lag(lon) OVER o, lon) AS lon0, lead(lat) OVER o IS NULL AS ending FROM x WINDOW o AS (PARTITION BY activity_id ORDER BY k)),
g AS (SELECT activity_id, k, lat, lon, radians(CASE WHEN ending THEN lat0 ELSE lat END) AS p, radians(CASE WHEN ending THEN lat ELSE lat2 END) AS q, radians(CASE WHEN ending THEN lon - lon0 ELSE lon2 - lon END) AS dl FROM e),
a AS (SELECT activity_id, min(ts) AS start_ts, count(*) * 45 AS moving_time, count(*) // 2 AS n FROM point GROUP BY 1), c AS (SELECT *, greatest(2, least(n, 14, 5 + moving_time // 1200)) AS m FROM a WHERE n >= 2),
i AS (SELECT c.*, CAST(r.range AS INTEGER) AS sample, CAST(r.range AS DOUBLE) / (m - 1) AS progress FROM c, range(14) r WHERE r.range < m)
SELECT i.activity_id, sample, CAST(floor(progress * (n - 1) + 0.5) AS INTEGER) AS index, lat, lon, {number('progress', 6)} AS progress, start_ts + to_milliseconds(CAST(floor(progress * moving_time * 1000 + 0.5) AS BIGINT)) AS at,
  {number('(degrees(atan2(sin(dl) * cos(q), cos(p) * sin(q) - sin(p) * cos(q) * cos(dl))) + 360) % 360', 4)} AS bearing FROM i JOIN g ON g.activity_id = i.activity_id AND g.k = CAST(floor(progress * (n - 1) + 0.5) AS BIGINT)""")
def route_samples(spark, sf_dir):
    code = F.char(63 + F.col("power").cast("long") % 32)
    drawn = A.points(spark, sf_dir).groupBy("activity_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", code.alias("c")))), lambda s: s["c"]), "").alias("line"), F.min("ts").alias("start_ts"), (F.count("*") * 45).alias("moving_time"))
    s = routes.samples(drawn.withColumn("line", S.decoded_polyline(F.col("line"))))
    return s.select("activity_id", "sample", "index", "lat", "lon", S.half_up(F.col("progress"), 6).alias("progress"), "at", S.half_up(F.col("bearing"), 4).alias("bearing"))
