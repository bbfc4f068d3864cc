"""Analyses by sport over the tracks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import analysis, sports
from paceline.operators.insights import insight_rows
from paceline.plans.base import number, query
from paceline.plans.tracks import FATIGUE, STEPS
from paceline.sources import adapters as A

#: Thresholds for climbs on the short tracks of the tables, and the same in SQL.
CLIMBS = (("min_km", 0.01), ("min_gain", 1.0), ("min_grade", 3.0), ("merge_km", 0.02))
FACTS = f"""{A.POINTS}, {STEPS}, x AS (SELECT *, lag(idx) OVER o IS NOT NULL AS later, CASE WHEN bearing <> 0 AND lag(bearing) OVER o <> 0 THEN abs(bearing - lag(bearing) OVER o) END AS turn, elevation - lag(elevation) OVER o AS rise,
  coalesce(speed - lag(speed) OVER o, 0) AS d_speed, coalesce(speed - lag(speed) OVER o, 0) / nullif(d_time, 0) AS acceleration, moving AND speed > 0 AS going, count(*) OVER (PARTITION BY activity_id) AS n FROM k WINDOW o AS (PARTITION BY activity_id ORDER BY idx))"""
WHOLE = "CASE WHEN km > 0 THEN km ELSE 1 END"


def _runs(name: str, inside: str, source: str = "x") -> str:
    """Table ``name``: the rows inside, numbered by runs, with the number of rows of the activity."""
    return f"{name}f AS (SELECT *, coalesce({inside}, false) AS here FROM {source}), {name}s AS (SELECT *, CASE WHEN here AND NOT coalesce(lag(here) OVER (PARTITION BY activity_id ORDER BY idx), false) THEN 1 ELSE 0 END AS st FROM {name}f), {name} AS (SELECT * FROM (SELECT *, sum(st) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM {name}s) WHERE here)"


CLIMB_SQL = f"""{_runs('cr', 'grade >= 3 AND moving')}, c0 AS (SELECT activity_id, run, min(idx) AS s, max(idx) AS e, min(km) AS a, max(km) AS b, {number('sum(greatest(climb, 0))', 6)} AS g, max(grade) AS mg, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS sec FROM cr GROUP BY 1, 2),
c1 AS (SELECT *, b - a AS len FROM c0 WHERE {number('b - a', 6)} >= CAST(0.01 AS DOUBLE) AND g >= 1 AND g / ((b - a) * 1000) * 100 >= 3), c2 AS (SELECT *, CASE WHEN {number('a - lag(b) OVER (PARTITION BY activity_id ORDER BY s)', 6)} <= CAST(0.02 AS DOUBLE) THEN 0 ELSE 1 END AS far FROM c1),
c3 AS (SELECT *, sum(far) OVER (PARTITION BY activity_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS m FROM c2), climb AS (SELECT activity_id, min(s) AS start_idx, max(e) AS end_idx, sum(len) AS km, sum(g) AS gain, CAST(sum(sec) AS BIGINT) AS seconds, max(mg) AS max_grade, sum(g) / (sum(len) * 1000) * 100 AS grade, CASE WHEN sum(sec) > 0 THEN sum(g) / sum(sec) * 3600 END AS vam FROM c3 GROUP BY activity_id, m)"""


def rounded(df, **digits: int):
    return df.withColumns({c: S.half_up(F.col(c), d) for c, d in digits.items()})


def _one(spark, sf_dir, kind: str, wind: bool = False):
    """One analysis over all tracks, whatever their sport."""
    p = A.points(spark, sf_dir)
    return sports.analysed(p, kinds=(kind,) if kind else (), fatigue=False, wind=_wind() if wind else None, climbs=dict(CLIMBS))


@query(f"""WITH {FACTS}, g AS (SELECT activity_id, max(km) AS km, count(*) AS n, avg(abs(d_speed)) FILTER (later) AS sv, avg(abs(rise)) FILTER (later) AS rv, sum(CASE WHEN later THEN CASE WHEN turn > 30 THEN 2 ELSE 0 END + CASE WHEN abs(grade) > 10 THEN 1 ELSE 0 END + CASE WHEN abs(rise) > 2 THEN 1 ELSE 0 END ELSE 0 END) AS tp FROM x GROUP BY 1), s AS (SELECT *, sv * 10 + rv * 5 AS r, tp / n * 100 AS t FROM g)
SELECT activity_id, {number('r', 0)} AS roughness, {number('sv', 1)} AS speed_variation, {number('rv', 2)} AS rise_variation, CASE WHEN r > 50 THEN 'very_rough' WHEN r > 30 THEN 'rough' WHEN r > 15 THEN 'moderate' ELSE 'smooth' END AS surface,
  {number('t', 0)} AS technical_score, CASE WHEN t > 30 THEN 'extreme' WHEN t > 20 THEN 'very_technical' WHEN t > 10 THEN 'technical' ELSE 'easy' END AS difficulty FROM s""")
def gravel_terrain(spark, sf_dir):
    g = _one(spark, sf_dir, "gravel").select("activity_id", "gravel.*")
    return g.select("activity_id", F.col("roughness").cast("double").alias("roughness"), "speed_variation", "rise_variation", "surface", F.col("technical_score").cast("double").alias("technical_score"), "difficulty")


#: Samples of the tables are minutes apart, so accelerations are taken a hundred times as large here (once divided by time, as in the SQL: the order decides ties).
@query(f"""WITH {FACTS}, a AS (SELECT activity_id, km, later, acceleration * 100 AS a FROM x), g AS (SELECT activity_id, max(km) AS km, count(*) FILTER (later AND a < -0.5) AS brakings, avg(-a) FILTER (later AND a < -0.5) AS braking, count(*) FILTER (later AND a > 0.5) AS bursts, avg(a) FILTER (later AND a > 0.5) AS burst FROM a GROUP BY 1)
SELECT activity_id, brakings, {number('coalesce(braking, 0)', 4)} AS braking, {number(f'brakings / {WHOLE}', 4)} AS brakings_a_km, bursts, {number('coalesce(burst, 0)', 4)} AS burst, {number(f'bursts / {WHOLE}', 4)} AS bursts_a_km FROM g""")
def gravel_braking(spark, sf_dir):
    g = sports.analysed(A.points(spark, sf_dir), kinds=("gravel",), fatigue=False, acceleration_scale=100.0).select("activity_id", "gravel.*")
    return rounded(g.select("activity_id", "brakings", "braking", "brakings_a_km", "bursts", "burst", "bursts_a_km"), braking=4, brakings_a_km=4, burst=4, bursts_a_km=4)


@query(f"""WITH {FACTS}, {CLIMB_SQL}, {_runs('dr', 'grade < -2')}, ds AS (SELECT activity_id, count(*) AS descents FROM (SELECT activity_id, run, max(idx) AS e, any_value(n) AS n FROM dr GROUP BY 1, 2) WHERE e < n - 1 GROUP BY 1), c AS (SELECT activity_id, count(*) AS climbs FROM climb GROUP BY 1),
g AS (SELECT activity_id, max(km) AS km, avg(60 / (speed / exp(grade / 100 * CAST(0.05 AS DOUBLE)))) FILTER (going) AS gap, count(*) FILTER (abs(grade) > 8) * CAST(100 AS DOUBLE) / nullif(count(*) FILTER (moving), 0) AS t, avg(speed) FILTER (going AND grade < -2) AS ds, max(speed) FILTER (going AND grade < -2) AS dt, avg(speed) FILTER (going) AS sp FROM x GROUP BY 1),
s AS (SELECT *, ds / CASE WHEN sp > 0 THEN sp ELSE 1 END AS e FROM g)
SELECT s.activity_id, {number('gap', 4)} AS gap, coalesce(descents, 0) AS descents, {number(f'coalesce(climbs, 0) / {WHOLE}', 4)} AS climbs_a_km, CAST({number('t', 0)} AS INTEGER) AS technical_score, CASE WHEN t > 15 THEN 'technical' WHEN t > 5 THEN 'moderate' ELSE 'easy' END AS terrain, {number('ds', 1)} AS descent_speed, {number('dt', 1)} AS descent_top,
  CAST({number('e * 100', 0)} AS INTEGER) AS descent_efficiency, CASE WHEN e > 1.5 THEN 'excellent' WHEN e > 1.2 THEN 'good' WHEN e IS NOT NULL THEN 'moderate' END AS descent_quality FROM s LEFT JOIN ds ON ds.activity_id = s.activity_id LEFT JOIN c ON c.activity_id = s.activity_id""")
def trail_terrain(spark, sf_dir):
    t = _one(spark, sf_dir, "trail").select("activity_id", "trail.*")
    return rounded(t.select("activity_id", "gap", "descents", "climbs_a_km", "technical_score", "terrain", "descent_speed", "descent_top", "descent_efficiency", "descent_quality"), gap=4, climbs_a_km=4)


@query(f"""WITH {FACTS}, {_runs('zr', '(abs(grade) > 8 OR coalesce(abs(rise) > 2, false)) AND NOT moving')}, z AS (SELECT activity_id, run, min(idx) AS s, max(idx) + 1 AS e, min(km) AS a, max(km) AS b, any_value(n) AS n FROM zr GROUP BY 1, 2)
SELECT activity_id, CAST(s AS INTEGER) AS start_idx, CAST(e AS INTEGER) AS end_idx, {number('a', 4)} AS start_km, {number('b', 4)} AS end_km FROM z WHERE e < n""")
def technical_zones(spark, sf_dir):
    z = _one(spark, sf_dir, "trail").select("activity_id", F.inline("trail.zones"))
    return rounded(z.select("activity_id", "start_idx", "end_idx", "start_km", "end_km"), start_km=4, end_km=4)


@query(f"""WITH {FACTS}, m AS (SELECT *, grade > 2 AND moving AS u, grade < -1 AND moving AS d FROM x), g AS (SELECT activity_id, max(km) AS km, max(gain) AS gain, max(loss) AS loss, max(grade) AS steepest, max(abs(grade)) AS st, sum(d_time) FILTER (moving) AS ms, sum(d_time) FILTER (u) AS us,
  arg_max(km, idx) FILTER (u) - arg_min(km, idx) FILTER (u) AS uk, arg_max(gain, idx) FILTER (u) - arg_min(gain, idx) FILTER (u) AS ug, avg(speed) FILTER (u AND speed > 0) AS up, sum(d_time) FILTER (d) AS dsec, avg(speed) FILTER (d AND speed > 0) AS dsp, max(speed) FILTER (d AND speed > 0) AS dtop FROM m GROUP BY 1),
s AS (SELECT *, coalesce(gain / nullif(km, 0), 0) AS a, coalesce(gain / nullif(km, 0), 0) * 10 + st / 2 AS score FROM g)
SELECT activity_id, {number('a', 3)} AS gain_a_km, steepest, {number('coalesce(gain / nullif(loss, 0), 0)', 4)} AS gain_to_loss, {number('up', 1)} AS climb_speed, CAST({number('us / nullif(CAST(ms AS DOUBLE), 0) * 100', 0)} AS INTEGER) AS climb_time, CAST({number('ug / nullif(uk * 1000, 0) * 100', 0)} AS INTEGER) AS climb_grade,
  {number('dsp', 1)} AS descent_speed, {number('dtop', 1)} AS descent_top, CAST({number('dsec / nullif(CAST(ms AS DOUBLE), 0) * 100', 0)} AS INTEGER) AS descent_time, {number('score', 2)} AS difficulty_score, CASE WHEN score > 15 THEN 'very_hard' WHEN score > 10 THEN 'hard' WHEN score > 5 THEN 'moderate' ELSE 'easy' END AS difficulty FROM s""")
def hiking_effort(spark, sf_dir):
    return rounded(_one(spark, sf_dir, "hiking").select("activity_id", "hiking.*"), gain_a_km=3, gain_to_loss=4, difficulty_score=2)


def _wind():
    """Speed and direction of each track's wind."""
    return F.col("activity_id") % 20 + 7.3, (F.col("activity_id") * 31 % 360).cast("double")


WIND = f"""{FACTS}, w AS (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY idx) - 1 AS place, (activity_id % 20 + CAST(7.3 AS DOUBLE)) * cos(radians(CASE WHEN abs(bearing - f) > 180 THEN 360 - abs(bearing - f) ELSE abs(bearing - f) END)) AS wind FROM (SELECT *, CAST(activity_id * 31 % 360 AS DOUBLE) AS f FROM x WHERE going)),
v AS (SELECT *, greatest(0, CAST(0.5 AS DOUBLE) * CAST(1.225 AS DOUBLE) * CAST(0.3 AS DOUBLE) * pow(speed / CAST(3.6 AS DOUBLE) + wind / CAST(3.6 AS DOUBLE), 2) * (speed / CAST(3.6 AS DOUBLE))) AS drag, 60 / greatest(CAST(0.1 AS DOUBLE), speed + wind / 10) AS wap FROM w)"""


@query(f"""WITH {WIND}, g AS (SELECT activity_id, count(*) AS wind_samples, {number('coalesce(sum(wind * speed) FILTER (wind > 2), 0)', 0)} AS headwind_penalty, {number('coalesce(sum(abs(wind * speed)) FILTER (wind < -1), 0)', 0)} AS tailwind_bonus, {number('coalesce(avg(drag) FILTER (drag > 0), 0)', 0)} AS drag FROM v GROUP BY 1),
m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY activity_id ORDER BY {number('abs(wind)', 9)} DESC, place) = 1) SELECT g.*, CAST(place AS BIGINT) AS windiest_idx, {number('wind', 4)} AS windiest, {number('wap', 3)} AS wind_adjusted_pace FROM g JOIN m ON g.activity_id = m.activity_id""")
def aero_summary(spark, sf_dir):
    a = _one(spark, sf_dir, "", wind=True).select("activity_id", "aero.*").where("wind_samples > 0")
    return a.select("activity_id", "wind_samples", "headwind_penalty", "tailwind_bonus", "drag", F.col("windiest.idx").alias("windiest_idx"), S.half_up(F.col("windiest.wind"), 4).alias("windiest"), S.half_up(F.col("windiest.wap"), 3).alias("wind_adjusted_pace"))


@query(f"""WITH {WIND}, o AS (SELECT activity_id, place AS idx, wind, count(*) OVER (PARTITION BY activity_id) AS n FROM v), {_runs('wr', 'abs(wind) > 5', 'o')}
SELECT activity_id, CAST(min(idx) AS BIGINT) AS start_idx, CAST(max(idx) + 1 AS BIGINT) AS end_idx, {number('max(abs(wind))', 4)} AS severity FROM wr GROUP BY activity_id, run HAVING max(idx) < any_value(n) - 1""")
def aero_walls(spark, sf_dir):
    return rounded(_one(spark, sf_dir, "", wind=True).select("activity_id", F.inline("aero.walls")), severity=4)


def _analysed(spark, sf_dir, mode: str):
    p = A.points(spark, sf_dir).withColumns(dict(zip(("wind_speed", "wind_direction"), _wind(), strict=True)))
    return analysis.analyse(p, analysis.Plan.mode(mode, climbs=CLIMBS))


_S = "lower(sport_type)"
KIND = f"CASE WHEN {_S} LIKE '%run%' THEN CASE WHEN {_S} LIKE '%trail%' THEN 'trail' ELSE 'running' END WHEN {_S} LIKE '%ride%' OR {_S} LIKE '%bike%' OR {_S} LIKE '%mtb%' THEN CASE WHEN {_S} LIKE '%gravel%' OR {_S} LIKE '%mtb%' OR {_S} LIKE '%mountainbike%' THEN 'gravel' ELSE 'cycling' END WHEN {_S} LIKE '%hike%' THEN 'hiking' ELSE 'base' END"
#: A row for each activity: the sums that documents and insights are made of.
ANALYSED = f"""{FACTS}, {CLIMB_SQL}, {FATIGUE.replace(STEPS + ', ', '')}, {_runs('sr', 'speed < 0.5 AND NOT moving')}, st AS (SELECT activity_id, count(*) AS stops FROM (SELECT activity_id, run, sum(d_time) AS sec FROM sr GROUP BY 1, 2) WHERE sec >= 5 GROUP BY 1),
cl AS (SELECT activity_id, count(*) AS climbs, max(vam) FILTER (vam > 0) AS vam, arg_max(km, (grade, -start_idx)) AS hard_km, max(grade) AS hard_grade FROM climb GROUP BY 1),
ca AS (SELECT activity_id, cadence, row_number() OVER (PARTITION BY activity_id ORDER BY cadence) - 1 AS r, count(*) OVER (PARTITION BY activity_id) AS cn FROM point WHERE cadence > 0), cq AS (SELECT activity_id, max(cadence) FILTER (r = floor(cn * CAST(0.25 AS DOUBLE))) AS q1, max(cadence) FILTER (r = floor(cn * CAST(0.75 AS DOUBLE))) AS q3, any_value(cn) AS cn FROM ca GROUP BY 1),
cs AS (SELECT ca.activity_id, count(*) FILTER (cadence BETWEEN q1 AND q3) * CAST(100 AS DOUBLE) / any_value(cq.cn) AS steady FROM ca JOIN cq ON ca.activity_id = cq.activity_id WHERE cq.cn >= 2 GROUP BY 1),
na AS (SELECT activity_id, idx, power, n, avg(CASE WHEN power > 0 THEN power END) OVER (PARTITION BY activity_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS ahead FROM x), np AS (SELECT activity_id, coalesce(pow(avg(pow(ahead, 4)) FILTER (idx < n - 30), CAST(0.25 AS DOUBLE)), avg(power) FILTER (power > 0)) AS np FROM na GROUP BY 1),
bs AS (SELECT activity_id, any_value(sport_type) AS sport_type, max(km) AS km, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000 AS seconds, coalesce(sum(d_time) FILTER (moving), 0) AS ms, max(gain) AS gain, max(loss) AS loss, coalesce(avg(speed) FILTER (going), 0) AS speed, coalesce(max(speed) FILTER (going), 0) AS top_speed, avg(heart_rate) FILTER (heart_rate > 0) AS hr, max(heart_rate) AS hr_max,
  avg(power) FILTER (power > 0) AS watts, avg(cadence) FILTER (cadence > 0) AS cadence, avg(heart_rate) FILTER (idx < n // 4) AS h1, avg(heart_rate) FILTER (idx >= n - n // 4) AS h2, avg(60 / speed) FILTER (going) AS pace, avg(60 / (speed / exp(grade / 100 * CAST(0.05 AS DOUBLE)))) FILTER (going) AS gap FROM x GROUP BY 1),
an AS (SELECT bs.*, {KIND} AS kind, (h2 - h1) / nullif(h1, 0) * 100 AS hr_drift, coalesce(climbs, 0) AS climbs, vam, hard_km, hard_grade, coalesce(stops, 0) AS stops, steady, np, CAST({number('ms / CAST(3600 AS DOUBLE) * np * (np / 250) / 250 * 100', 0)} AS INTEGER) AS tss, detected, onset_km, severity, events
  FROM bs LEFT JOIN cl ON cl.activity_id = bs.activity_id LEFT JOIN st ON st.activity_id = bs.activity_id LEFT JOIN cs ON cs.activity_id = bs.activity_id LEFT JOIN np ON np.activity_id = bs.activity_id LEFT JOIN fatigued ON fatigued.activity_id = bs.activity_id)"""


@query(f"""WITH {ANALYSED} SELECT activity_id, sport_type, kind, {number('km', 4)} AS km, CAST(ms AS BIGINT) AS moving_seconds, CAST(climbs AS INTEGER) AS climbs, CAST(stops AS INTEGER) AS stops, detected AS tired, CASE WHEN kind IN ('running', 'trail') THEN {number('pace', 4)} END AS pace,
  CASE WHEN kind IN ('running', 'trail') THEN CASE WHEN gain / nullif(km, 0) > 0.05 THEN 'hill workout' WHEN km > 20 THEN 'long run' WHEN hr_drift > 5 THEN 'tempo run' ELSE 'easy run' END END AS session, CASE WHEN kind = 'trail' THEN {number('gap', 4)} END AS gap,
  CASE WHEN kind IN ('cycling', 'gravel') THEN {number('np', 4)} END AS np, CASE WHEN kind IN ('cycling', 'gravel') THEN tss END AS tss, CASE WHEN kind IN ('cycling', 'gravel') THEN CASE WHEN np / 250 < 0.75 THEN 'endurance' WHEN np / 250 < 0.85 THEN 'steady' WHEN np / 250 < 1.05 THEN 'tempo' WHEN np / 250 < 1.2 THEN 'threshold' ELSE 'vo2max' END END AS effort FROM an""")
def analysis_by_sport(spark, sf_dir):
    a = _analysed(spark, sf_dir, "normal")
    return a.select(
        "activity_id", "sport_type", "kind", S.half_up(F.col("km"), 4).alias("km"), "moving_seconds", F.size("climbs").alias("climbs"), F.size("stops").alias("stops"), F.col("fatigue.detected").alias("tired"), S.half_up(F.col("running.pace"), 4).alias("pace"), F.col("running.session").alias("session"),
        S.half_up(F.col("trail.gap"), 4).alias("gap"), S.half_up(F.col("cycling.np"), 4).alias("np"), F.col("cycling.tss").alias("tss"), F.col("cycling.effort").alias("effort"),
    )


def _fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {number(x, digits)})"


def _pace(x: str) -> str:
    return f"CAST(floor({x} * 60 + 0.5) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor({x} * 60 + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0')"


_SPENT = "CASE WHEN ms >= 3600 THEN ms // 3600 || 'h ' || ms % 3600 // 60 || 'm ' || ms % 60 || 's' WHEN ms >= 60 THEN ms // 60 || 'm ' || ms % 60 || 's' ELSE ms || 's' END"
_FOOT, _RIDE = "kind IN ('running', 'trail')", "kind IN ('cycling', 'gravel') AND watts > 0"
_SAID = [
    ("done", "true", f"'Completed ' || {_fixed('km', 2)} || ' km in ' || {_SPENT}"), ("slow", "speed < 10", f"'Average speed was ' || {_fixed('speed', 1)} || ' km/h'"), ("quick", "speed > 30", f"'Quick pace! Average speed was ' || {_fixed('speed', 1)} || ' km/h'"),
    ("climbing", "gain > 500", f"'Significant climbing: ' || {_fixed('gain', 0)} || 'm of elevation gain'"), ("pace", f"{_FOOT} AND pace IS NOT NULL", f"'Average pace: ' || {_pace('pace')} || '/km'"),
    ("gain", "gain > 200", f"'Elevation gain of ' || {_fixed('gain', 0)} || 'm (' || {_fixed('gain / nullif(km, 0)', 1)} || 'm/km average gradient)'"), ("onset", "detected AND onset_km > 0", f"'Fatigue detected at km ' || {_fixed('onset_km', 1)}"),
    ("severe", "detected AND severity > 0.75", "'Severe fatigue impact detected during the activity'"), ("moderate", "detected AND severity > 0.5 AND severity <= 0.75", "'Moderate fatigue indicators observed'"),
    ("gap", "kind = 'trail' AND gap IS NOT NULL", f"'Grade-adjusted pace (GAP) average: ' || {_pace('gap')} || '/km'"), ("power", "watts > 0", f"'Average power: ' || {_fixed('watts', 0)} || 'W'"), ("np", f"{_RIDE} AND np > 0", f"'Normalized power: ' || {_fixed('np', 0)} || 'W'"),
    ("tss", f"{_RIDE} AND tss <> 0", "'Training Stress Score (TSS): ' || tss"), ("climb_vam", f"{_RIDE} AND vam IS NOT NULL", f"'Best VAM on climbs: ' || {_fixed('vam', 0)} || ' m/h'"), ("hr", "hr > 0", f"'Average heart rate: ' || {_fixed('hr', 0)} || ' bpm (max ' || {_fixed('hr_max', 0)} || ' bpm)'"),
    ("drift", "hr > 0 AND floor(hr_drift + 0.5) > 5", f"'Heart rate drift: +' || {_fixed('hr_drift', 0)} || '% (signs of fatigue)'"), ("steady", "hr > 0 AND floor(hr_drift + 0.5) < -5", "'Negative HR drift: good pacing stability'"),
    ("hardest", "climbs > 0", f"'Hardest climb: ' || {_fixed('hard_km', 2)} || 'km at ' || {_fixed('hard_grade', 1)} || '%'"), ("vam", "climbs > 0 AND vam IS NOT NULL", f"'Best VAM: ' || {_fixed('vam', 0)} || ' m/h'"),
    ("cadence", f"{_FOOT} AND steady IS NOT NULL", f"'Cadence stability: ' || {_fixed('steady', 0)} || '% (' || CASE WHEN steady > 80 THEN 'high' WHEN steady > 60 THEN 'moderate' ELSE 'low' END || ')'"),
]


@query(f"WITH {ANALYSED} " + " UNION ALL ".join(f"SELECT activity_id, {k + 1} AS priority, '{code}' AS code, {text} AS text FROM an WHERE {held}" for k, (code, held, text) in enumerate(_SAID)))
def activity_insights(spark, sf_dir):
    return insight_rows(_analysed(spark, sf_dir, "normal"))


@query(f"""WITH {ANALYSED}, cj AS (SELECT activity_id, list('Climb ' || {_fixed('km', 1)} || 'km @ ' || {_fixed('grade', 1)} || '%' ORDER BY start_idx) AS names FROM climb GROUP BY 1)
SELECT an.activity_id, kind, {number('km', 2)} AS distance, CASE WHEN seconds >= 3600 THEN seconds // 3600 || 'h ' || seconds % 3600 // 60 || 'm' ELSE seconds // 60 || 'm ' || seconds % 60 || 's' END AS duration, {number(number('gain', 6), 0)} AS elevation_gain, {number('speed', 2)} AS avg_speed, {number('hr', 0)} AS avg_hr, {number('watts', 0)} AS avg_power,
  CASE WHEN kind IN ('cycling', 'gravel') THEN {number('np', 0)} END AS normalized_power, coalesce(array_to_string(names, ', '), '') AS climb_names, events AS fatigue_events, 1 + {' + '.join(f'CAST(coalesce({held}, false) AS INTEGER)' for _, held, _ in _SAID[1:])} AS insights FROM an LEFT JOIN cj ON cj.activity_id = an.activity_id""")
def result_documents(spark, sf_dir):
    d = analysis.document(_analysed(spark, sf_dir, "deep"))
    s = F.col("summary")
    return d.select(
        "activity_id", "metadata.kind", s["distance"].alias("distance"), s["duration"].alias("duration"), s["elevation_gain"].alias("elevation_gain"), s["avg_speed"].alias("avg_speed"), s["avg_hr"].alias("avg_hr"), s["avg_power"].alias("avg_power"), s["normalized_power"].alias("normalized_power"),
        F.array_join(F.transform("detailed.climbs", lambda c: c["name"]), ", ").alias("climb_names"), F.col("detailed.fatigue.events").alias("fatigue_events"), F.size("insights").alias("insights"),
    )


@query(f"""WITH {A.ACTIVITIES}, b AS (SELECT id, sport_type, lower(sport_type) AS s FROM activity) SELECT id, array_to_string(['time', 'latlng', 'distance', 'altitude', 'velocity_smooth', 'grade_smooth', 'moving']
  || CASE WHEN s LIKE '%run%' THEN ['heartrate', 'cadence'] WHEN s LIKE '%ride%' OR s LIKE '%bike%' THEN ['heartrate', 'cadence', 'watts'] WHEN s LIKE '%hike%' OR s LIKE '%walk%' THEN ['heartrate'] ELSE [] END, ',') AS streams FROM b""")
def required_streams(spark, sf_dir):
    return analysis.required_streams(A.activities(spark, sf_dir)).select("id", F.array_join("streams", ",").alias("streams"))
