"""Readiness and prediction queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import forecast as P
from paceline.plans.base import number, query
from paceline.plans.tracks import _COST, _MISS, _SLOPE
from paceline.sources import adapters as A


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def _position(x: str, levels, always: bool) -> str:
    low = f"greatest(0, {x} / {_d(levels[0][0])} * 30)"
    cases = []
    for k, (a, b) in reversed(list(enumerate(levels))):
        score = f"({k} + least(1, ({x} - {a}) / {_d(b - a)})) / {_d(3)} * 100"
        cases.append(f"WHEN {x} >= {a} THEN " + (score if always or k else f"CASE WHEN {score} = 0 AND {x} > 0 THEN {low} ELSE {score} END"))
    return f"CASE {' '.join(cases)} ELSE {low} END"


def _score(r) -> str:
    raw = f"{_position('weekly_km', r[2], True)} * {_d(0.35)} + {_position('longest_km', r[3], False)} * {_d(0.3)} + {_position('days_a_week', r[4], False)} * {_d(0.15)} + consistency * 100 * {_d(0.1)} + least(15, greatest(-15, trend * 50)) * {_d(0.1)} + 50 * {_d(0.1)}"
    return f"least(100, greatest(0, {raw}))"


def _training(source: str, keys: str, weeks: str) -> str:
    """Tables ``p, w, h, t``: the training of each key from the runs of ``source``."""
    on = " AND ".join(f"p.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    return f"""p AS (SELECT *, CASE WHEN distance > 0 AND moving_time > 0 THEN moving_time / (distance / 1000) END AS pace FROM {source}), m AS (SELECT {keys}, avg(pace) AS mean FROM p GROUP BY ALL),
w AS (SELECT {', '.join(f'p.{k.strip()}' for k in keys.split(','))}, date_trunc('week', day)::DATE AS week, sum(distance / 1000) AS km, max(distance / 1000) AS longest, count(DISTINCT day) AS days, count(*) FILTER (pace < mean * {_d(0.92)}) AS fast FROM p JOIN m ON {on} GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY week) > count(*) OVER (PARTITION BY {keys}) // 2 AS late FROM w),
t AS (SELECT {keys}, count(*) AS weeks, avg(km) AS weekly_km, max(longest) AS longest_km, avg(days) AS days_a_week, CASE WHEN count(*) >= 4 THEN coalesce((avg(km) FILTER (late) - avg(km) FILTER (NOT late)) / avg(km) FILTER (NOT late), 0) ELSE 0 END AS trend,
  sum(fast) / count(*) AS fast_a_week, count(*) FILTER (km > 0) / {weeks} AS consistency FROM h GROUP BY ALL)"""


def _assessed(r) -> str:
    level = " ".join(f"WHEN weekly_km >= {a} THEN '{n}'" for n, (a, _) in reversed(list(zip(P.LEVELS, r[2], strict=True))))
    advice = f"""list_filter([CASE WHEN weekly_km < {r[2][0][0]} THEN 'more_volume' END, CASE WHEN longest_km < {r[3][0][0]} THEN 'longer_run' END, CASE WHEN days_a_week < {r[4][0][0]} THEN 'more_days' END, CASE WHEN consistency < 0.7 THEN 'steadier_weeks' END,
  CASE WHEN trend < -0.1 THEN 'volume_declines' END, CASE WHEN {_score(r)} >= 70 AND fast_a_week < 1.5 THEN 'more_quality' END], lambda x: x IS NOT NULL)"""
    return f"SELECT a.athlete_id, '{r[0]}' AS race, CASE WHEN weeks IS NULL THEN 0 ELSE CAST(floor({_score(r)} + 0.5) AS INTEGER) END AS score, CASE WHEN weeks IS NULL THEN 'No data' {level} ELSE 'Insufficient' END AS level, CASE WHEN weeks IS NULL THEN '' ELSE array_to_string({advice}, ',') END AS advice FROM a LEFT JOIN t ON a.athlete_id = t.athlete_id"


@query(f"""WITH {A.HISTORY}, a AS (SELECT DISTINCT athlete_id FROM history), o AS (SELECT * FROM history WHERE day BETWEEN DATE '1998-03-31' - 56 AND DATE '1998-03-31'), {_training('o', 'athlete_id', '8')}
{' UNION ALL '.join(map(_assessed, P.REFERENCES))}""")
def race_readiness(spark, sf_dir):
    r = P.race_readiness(A.history(spark, sf_dir), ["athlete_id"], "1998-03-31")
    return r.select("athlete_id", "race", "score", "level", F.array_join("advice", ",").alias("advice"))


_RACES = ", ".join(f"({_d(k)}, {_d(m)}, {_d(p)})" for k, m, p in P.RACES)
_READY = "CASE " + " ".join(f"WHEN g.km = {_d(r[1])} THEN CASE WHEN weeks IS NULL THEN 0 ELSE floor({_score(r)} + 0.5) END" for r in P.REFERENCES) + " END"
_DET = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
_det = lambda *v: _DET.format(**dict(zip("abcdefghi", v, strict=True)))
_WHOLE = _det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_FITS = (_det("t0", "s1", "s2", "t1", "s2", "s3", "t2", "s3", "s4"), _det("n", "t0", "s2", "s1", "t1", "s3", "s2", "t2", "s4"), _det("n", "s1", "t0", "s1", "s2", "t1", "s2", "s3", "t2"))
_SUMS = ", ".join(["count(*) AS n", *[f"sum(pow(x, {k})) AS s{k}" for k in range(1, 5)], *[f"sum(y * pow(x, {k})) AS t{k}" for k in range(3)]])


def _predictions(granularity: str) -> str:
    """Every period recomputed from all runs up to its end."""
    return f"""WITH RECURSIVE {A.HISTORY}, e AS (SELECT athlete_id, date_trunc('{granularity}', day)::DATE AS period, max(day) AS "end" FROM history GROUP BY 1, 2),
u AS (SELECT e.athlete_id, period, "end", id, day, distance, moving_time FROM e JOIN history h ON h.athlete_id = e.athlete_id AND h.day <= e."end"), c AS (SELECT athlete_id, period, "end", count(*) AS runs FROM u GROUP BY ALL HAVING count(*) >= 2),
races AS (SELECT * FROM (VALUES {_RACES}) v(km, margin, late)), band AS (SELECT u.athlete_id, period, races.km AS target, id, distance / 1000 AS km, CAST(moving_time AS DOUBLE) AS seconds FROM u JOIN races ON distance / 1000 BETWEEN races.km * (1 - margin) AND races.km * (1 + margin) WHERE moving_time > 0),
b AS (SELECT * FROM band QUALIFY row_number() OVER (PARTITION BY athlete_id, period, target ORDER BY seconds / km, id) <= 3),
mean AS (SELECT athlete_id, period, avg(ln(km)) AS m FROM b GROUP BY ALL), xy AS (SELECT b.athlete_id, b.period, ln(km) - m AS x, seconds AS y FROM b JOIN mean ON b.athlete_id = mean.athlete_id AND b.period = mean.period),
s AS (SELECT athlete_id, period, {_SUMS} FROM xy GROUP BY ALL), fit AS (SELECT s.athlete_id, s.period, m, {', '.join(f'{top} / {_WHOLE} AS f{c}' for top, c in zip(_FITS, 'abc', strict=True))} FROM s JOIN mean ON s.athlete_id = mean.athlete_id AND s.period = mean.period WHERE n >= 3 AND abs({_WHOLE}) > 1e-9),
vs AS (SELECT athlete_id, period, id, {_COST.format(m='distance', t='(moving_time / CAST(60 AS DOUBLE))')} AS v FROM u WHERE distance >= 3000 AND moving_time > 0), vr AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, period ORDER BY v DESC, id) AS k FROM vs WHERE v > 10 AND v < 100),
vd AS (SELECT athlete_id, period, avg(v) AS vdot FROM vr WHERE k <= 5 GROUP BY ALL), g AS (SELECT * FROM races WHERE km NOT IN ({_d(15.0)}, {_d(30.0)})),
newton AS (SELECT athlete_id, period, km, km * 1000 AS target, vdot, km * CAST(4.5 AS DOUBLE) AS t, 0 AS k FROM vd, g UNION ALL SELECT athlete_id, period, km, target, vdot, CASE WHEN abs({_SLOPE}) < 1e-10 THEN t ELSE greatest(CAST(0.1 AS DOUBLE), t - {_MISS} / {_SLOPE}) END, k + 1 FROM newton WHERE k < 50),
o AS (SELECT athlete_id, period, day, distance, moving_time FROM u WHERE day >= "end" - 56), {_training('o', 'athlete_id, period', 'count(*)')},
told AS (SELECT athlete_id, period, g.km, seconds * pow(g.km / b.km, CAST(1.06 AS DOUBLE)) AS time, 30 AS weight FROM b, g WHERE abs(b.km - g.km) >= {_d(0.1)} UNION ALL SELECT athlete_id, period, g.km, fa + fb * (ln(g.km) - m) + fc * (ln(g.km) - m) * (ln(g.km) - m), 20 FROM fit, g
  UNION ALL SELECT athlete_id, period, target, seconds, 20 FROM b WHERE target IN (SELECT km FROM g) UNION ALL SELECT athlete_id, period, km, t * 60, 15 FROM newton WHERE k = 50),
good AS (SELECT told.* FROM told WHERE time > 0), l AS (SELECT athlete_id, period, km, list(time ORDER BY time) AS ts FROM good GROUP BY ALL),
ready AS (SELECT l.athlete_id, l.period, l.km, ts[len(ts) // 2 + 1] * (1 + (1 - {_READY} / CAST(100 AS DOUBLE)) * late) AS time, 90 AS weight FROM l JOIN g ON l.km = g.km LEFT JOIN t ON t.athlete_id = l.athlete_id AND t.period = l.period),
every AS (SELECT *, row_number() OVER (PARTITION BY athlete_id, period, km ORDER BY time, weight) - 1 AS k, count(*) OVER (PARTITION BY athlete_id, period, km) AS n FROM (SELECT * FROM good UNION ALL SELECT * FROM ready)),
blend AS (SELECT athlete_id, period, km, sum(time * weight) / sum(weight) AS blend FROM every WHERE k >= floor(n * CAST(0.25 AS DOUBLE)) AND k < ceil(n * CAST(0.75 AS DOUBLE)) GROUP BY ALL),
r AS (SELECT c.athlete_id, c.period, c."end", CAST(c.runs AS BIGINT) AS runs, g.km, blend FROM c CROSS JOIN g LEFT JOIN blend ON blend.athlete_id = c.athlete_id AND blend.period = c.period AND blend.km = g.km),
a3 AS (SELECT *, avg(blend) OVER (PARTITION BY athlete_id, km ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS p FROM r)
SELECT athlete_id, period, "end", runs, km, {number('blend', 0)} AS blend, {number('p', 0)} AS predicted, {number('p * CAST(0.95 AS DOUBLE)', 0)} AS low, {number('p * CAST(1.05 AS DOUBLE)', 0)} AS high FROM a3"""


@query(_predictions("month"))
def prediction_history(spark, sf_dir):
    out = P.prediction_history(A.history(spark, sf_dir), ["athlete_id"], "month")
    return out.withColumns({c: S.half_up(F.col(c)) for c in ("blend", "predicted", "low", "high")})
