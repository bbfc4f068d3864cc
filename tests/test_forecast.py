import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import forecast as P
from paceline.operators import load, routes
from paceline.streaming import folds


def runs_of(seed, n, athletes=2):
    rng = random.Random(seed)
    day = dt.date(2023, 11, 20)
    return [(rng.randrange(athletes), k, day + dt.timedelta(days=rng.randrange(120)), rng.choice([5010.0, 10020.0, 21000.0, 42000.0, 1600.0, 7000.0, 0.0]) + rng.randrange(50), rng.choice([0, 1400, 2900, 4100, 6500])) for k in range(n)]


COLUMNS = "athlete_id long, id long, day date, distance double, moving_time long"


def position(x, levels, always):
    score = None
    for k, (a, b) in enumerate(levels):
        if x >= a:
            score = (k + min(1, (x - a) / (b - a))) / 3 * 100
    if score is None or (score == 0 and not always):
        score = max(0, x / levels[0][0] * 30) if x > 0 else 0
    return score


def trained(runs):
    weeks = {}
    for r in runs:
        weeks.setdefault(r[2] - dt.timedelta(days=r[2].weekday()), []).append(r)
    km = [sum(r[3] for r in w) / 1000 for _, w in sorted(weeks.items())]
    mid = len(km) // 2
    first, second = (sum(km[:mid]) / mid, sum(km[mid:]) / (len(km) - mid)) if len(km) >= 4 else (0, 0)
    paces = [r[4] / (r[3] / 1000) for r in runs if r[3] > 0 and r[4] > 0]
    fast = sum(p < sum(paces) / len(paces) * 0.92 for p in paces)
    return {
        "weekly_km": sum(km) / len(km), "longest_km": max(r[3] for r in runs) / 1000, "days": sum(len({r[2] for r in w}) for w in weeks.values()) / len(weeks),
        "consistency": sum(k > 0 for k in km) / len(km), "trend": (second - first) / first if first > 0 else 0, "fast": fast / len(weeks),
    }


def score(t, r):
    parts = position(t["weekly_km"], r[2], True) * 0.35 + position(t["longest_km"], r[3], False) * 0.3 + position(t["days"], r[4], False) * 0.15 + t["consistency"] * 10
    return math.floor(max(0, min(100, parts + max(-15, min(15, t["trend"] * 50)) * 0.1 + 5)) + 0.5)


def vdot(km, seconds):
    m = seconds / 60
    v = km * 1000 / m
    return (-4.6 + 0.182258 * v + 0.000104 * v * v) / (0.8 + 0.1894393 * math.exp(-0.012778 * m) + 0.2989558 * math.exp(-0.1932605 * m))


def predicted(runs, end):
    """The blend for each race distance at one day, from all runs up to it."""
    runs = [r for r in runs if r[2] <= end]
    bests = []
    for km, margin, _ in P.RACES:
        near = sorted((r[4] / (r[3] / 1000), r[1], r[3] / 1000, r[4]) for r in runs if r[4] > 0 and km * (1 - margin) <= r[3] / 1000 <= km * (1 + margin))
        bests += [(km, x[2], x[3]) for x in near[:3]]
    top = sorted((v for v in (vdot(r[3] / 1000, r[4]) for r in runs if r[3] >= 3000 and r[4] > 0) if 10 < v < 100), reverse=True)[:5]
    out = {}
    for name, km, *levels in P.REFERENCES:
        told = [(s * (km / d) ** 1.06, 30) for _, d, s in bests if abs(d - km) >= 0.1] + [(s, 20) for t, _, s in bests if t == km]
        if len(bests) >= 3:
            import numpy as np

            x, y = np.log([d for _, d, _ in bests]), np.array([s for _, _, s in bests], float)
            a = np.stack([np.ones(len(x)), x - x.mean(), (x - x.mean()) ** 2], 1)
            if abs(np.linalg.det(a.T @ a)) > 1e-9:
                c = np.linalg.solve(a.T @ a, a.T @ y)
                z = math.log(km) - x.mean()
                if c[0] + c[1] * z + c[2] * z * z > 0:
                    told.append((c[0] + c[1] * z + c[2] * z * z, 20))
        if top:
            want, low, high = sum(top) / len(top), 0.1, 10000.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if vdot(km, mid * 60) > want else (low, mid)
            told.append((low * 60, 15))
        if told:
            recent = [r for r in runs if r[2] >= end - dt.timedelta(days=56)]
            late = {k: p for k, _, p in P.RACES}[km]
            told.append((sorted(told)[len(told) // 2][0] * (1 + (1 - score(trained(recent), (name, km, *levels)) / 100) * late), 90))
        told.sort()
        kept = told[math.floor(len(told) * 0.25) : math.ceil(len(told) * 0.75)]
        out[km] = sum(t * w for t, w in kept) / sum(w for _, w in kept) if kept else None
    return out


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
def test_history_equals_a_recomputation_of_each_period(spark, granularity):
    rows = runs_of(5, 60)
    got = P.prediction_history(spark.createDataFrame(rows, COLUMNS), ["athlete_id"], granularity).collect()
    own = {(r.athlete_id, r.end, r.km): r for r in got}
    start = {"day": lambda d: d, "week": lambda d: d - dt.timedelta(days=d.weekday()), "month": lambda d: d.replace(day=1)}[granularity]
    for athlete in (0, 1):
        mine, seen = [r for r in rows if r[0] == athlete], []
        periods = sorted({start(r[2]) for r in mine})
        for p in periods:
            end = max(r[2] for r in mine if start(r[2]) == p)
            if sum(r[2] <= end for r in mine) >= 2:
                seen.append((end, predicted(mine, end)))
        for km in (r[1] for r in P.REFERENCES):
            values = [s[km] for _, s in seen]
            for k, (end, s) in enumerate(seen):
                row = own.pop((athlete, end, km))
                assert row.blend == pytest.approx(s[km], rel=1e-6) if s[km] is not None else row.blend is None
                near = [v for v in values[max(0, k - 1) : k + 2] if v is not None]
                assert row.predicted == pytest.approx(sum(near) / len(near), rel=1e-6) if near else row.predicted is None
    assert not own


def test_running_best_values(spark):
    rows = [(k % 2, k, random.Random(k).randrange(9)) for k in range(40)]
    out = P.as_of_best(spark.createDataFrame(rows, "g int, k int, x int"), ["g"], ["k"], "x", 3).collect()
    for r in out:
        best = sorted(x for g, k, x in rows if g == r.g and k <= r.k)[:3]
        assert [r.best_1, r.best_2, r.best_3] == best + [None] * (3 - len(best))


def test_readiness_edges(spark):
    day = dt.date(2024, 3, 31)
    rows = [(1, k, day - dt.timedelta(days=k), 15000.0, 4000) for k in range(56)] + [(2, 99, dt.date(2020, 1, 1), 5000.0, 1500), (3, 100, day, 5000.0, 1500)]
    got = {(r.athlete_id, r.race): r for r in P.race_readiness(spark.createDataFrame(rows, COLUMNS), ["athlete_id"], "2024-03-31").collect()}
    assert len(got) == 15 and got[1, "5K"].level == "Advanced" and got[1, "5K"].advice == ["more_quality"]
    assert (got[2, "Mile"].score, got[2, "Mile"].level, got[2, "Mile"].advice) == (0, "No data", [])
    assert (got[3, "Marathon"].level, got[3, "Marathon"].advice) == ("Insufficient", ["more_volume", "longer_run", "more_days", "steadier_weeks"])
    exact = spark.range(1).select(P.position(F.lit(8.0), [(8, 10), (10, 13), (13, 16)], False), P.position(F.lit(15.0), [(15, 25), (25, 50), (50, 80)], True), P.position(F.lit(99.0), [(8, 10), (10, 13), (13, 16)], False), P.position(F.lit(0.0), [(8, 10), (10, 13), (13, 16)], False)).first()
    assert tuple(exact) == (30.0, 0.0, 100.0, 0.0)


def test_route_samples(spark):
    start = dt.datetime(2024, 1, 1, 8)
    line = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    rows = [(1, line, start, 3600.0), (2, line[:2], start, None), (3, line[:1], start, 60.0), (4, None, start, 60.0), (5, line * 10, start, 86400.0)]
    got = routes.samples(spark.createDataFrame(rows, "id int, line array<struct<lat: double, lon: double>>, start_ts timestamp, moving_time double")).collect()
    one = sorted((r.sample, r["index"], r.lat, r.lon, r.at, round(r.bearing)) for r in got if r.id == 1)
    assert one == [(k, k, *line[k], start + dt.timedelta(minutes=12 * k), b) for k, b in enumerate([90, 0, 270, 0, 0, 0])]
    assert [(r.sample, r["index"], r.at) for r in got if r.id == 2] == [(0, 0, start), (1, 1, start + dt.timedelta(milliseconds=1))]
    assert {r.id for r in got} == {1, 2, 5} and sum(r.id == 5 for r in got) == 14


def test_stream_fold_equals_the_batch_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    schema, first = "id long, athlete_id long, start_ts timestamp, tss double", dt.datetime(2024, 1, 1, 6)
    days = [[(100 * d + k, rng.randrange(3), first + dt.timedelta(days=d, hours=rng.randrange(12)), float(rng.randrange(90))) for k in range(rng.randrange(1, 5))] for d in range(12)]
    days[3].append((999, None, first, 5.0))
    days[5].append((998, 1, first + dt.timedelta(days=4), 7.0))  # out of order, but in time
    late = (997, 1, first, 1000.0)  # long closed

    def land(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = folds.exponential_load(events).writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()

    try:
        for k, rows in enumerate(days[:6]):
            land(f"a{k}", rows)
        run()
        for k, rows in enumerate(days[6:]):
            land(f"b{k}", rows)
        land("late", [late])
        run()
        land("end", [(1000, 7, first + dt.timedelta(days=40), 1.0)])
        land("end2", [(1001, 7, first + dt.timedelta(days=41), 1.0)])
        run()
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = spark.createDataFrame([r for d in days for r in d if r[1] is not None], schema).groupBy("athlete_id", F.to_date("start_ts").alias("day")).agg(F.sum("tss").alias("load"))
    loads = {(r.athlete_id, r.day): r["load"] for r in batch.collect()}
    want = {(r.athlete_id, r.day): (loads[r.athlete_id, r.day], r.average) for r in load.exponential(batch, "load", 7, "average").collect()}
    got = {(r.athlete_id, r.day): (r["load"], r.average) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.athlete_id != 7}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_analyses_against_plain_loops(spark):
    from paceline.operators import analysis, insights, points

    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1, 8)
    rows = []
    for a, (sport, n) in enumerate([("Run", 90), ("TrailRun", 61), ("GravelRide", 120), ("Hike", 45), (None, 9), ("Ride", 1)]):
        for k in range(n):
            none = lambda v: v if rng.random() > 0.1 else None
            rows.append((a, k, start + dt.timedelta(seconds=20 * k), rng.choice([0.0, 8.0, 12.5, 31.0]), float(rng.randrange(-12, 13)), rng.random() > 0.25, round(rng.uniform(0, 9), 2), float(rng.randrange(200)), none(float(rng.randrange(100, 190))), none(float(rng.randrange(0, 300))), none(float(rng.randrange(0, 100))), none(float(rng.randrange(360))), sport))
    schema = "activity_id long, idx int, ts timestamp, speed double, grade double, moving boolean, elevation double, step_m double, heart_rate double, power double, cadence double, bearing double, sport_type string"
    df = spark.createDataFrame(rows, schema)
    out = {r.activity_id: r for r in analysis.analyse(df.withColumns({"wind_speed": F.lit(9.0), "wind_direction": F.lit(40.0)}), analysis.Plan.mode("deep")).collect()}
    assert [out[a].kind for a in range(6)] == ["running", "trail", "gravel", "hiking", "base", "cycling"]
    assert out[0].trail is None and out[0].running is not None and out[1].running is not None and out[2].cycling is not None and out[3].gravel is None and out[4].hiking is None
    signs = {(r.activity_id, r.idx): r for r in points.fatigue(df).collect()}
    for a in range(6):
        mine = [r for r in rows if r[0] == a]
        n, km = len(mine), 0.0
        # fatigue by windows
        width = math.floor(n * 0.1)
        mean = lambda part, f: (lambda v: sum(v) / len(v) if v else None)([x for x in map(f, part) if x])
        measures = (lambda r: 60 / r[3] if r[5] and r[3] > 0 else None, lambda r: r[8], lambda r: r[10], lambda r: r[9])
        events = []
        for i in range(width, n) if width else ():
            one, two = mine[i - width : i], mine[i : i + width]
            held = []
            for f, limit, rises in zip(measures, (0.1, 0.05, 0.08, 0.08), (True, True, False, False), strict=True):
                x, y = mean(one, f), mean(two, f)
                held.append(bool(x and y and ((y - x) / x if rises else (x - y) / x) > limit))
            r = signs.pop((a, i))
            assert [r.pace_drop, r.hr_rise, r.cadence_drop, r.power_drop] == held and r.severity == pytest.approx(min(1, sum(held) * 0.3))
            if sum(held) >= 2:
                events.append((i, sum(held) * 0.3))
        f = out[a].fatigue
        assert (f.detected, f.events, f.onset_idx) == (bool(events), len(events), events[0][0] if events else None)
        # walls of wind among the moving samples
        going = [r for r in mine if r[5] and r[3] > 0]
        gap = lambda r: (lambda d: 360 - d if d > 180 else d)(abs((r[11] or 0.0) - 40.0))
        wind = [9.0 * math.cos(math.radians(gap(r))) for r in going]
        walls, begun = [], None
        for k, w in enumerate(wind):
            if abs(w) > 5 and begun is None:
                begun = k
            elif abs(w) <= 5 and begun is not None:
                walls.append((begun, k, max(map(abs, wind[begun:k]))))
                begun = None
        assert [(w.start_idx, w.end_idx) for w in out[a].aero.walls] == [w[:2] for w in walls] and [w.severity for w in out[a].aero.walls] == [pytest.approx(w[2]) for w in walls]
        # climbs as the operator over islands finds them
        want = points.climbs(df.where(F.col("activity_id") == a)).orderBy("start_idx").collect()
        assert [(c.start_idx, c.end_idx, c.seconds) for c in out[a].climbs] == [(c.start_idx, c.end_idx, c.seconds) for c in want]
        assert [c.gain for c in out[a].climbs] == [pytest.approx(c.gain) for c in want]
        km = sum(r[7] for r in mine) / 1000
        assert out[a].km == pytest.approx(km) and [(s.start_idx, s.end_idx, s.seconds) for s in out[a].stops] == [(s.start_idx, s.end_idx, s.seconds) for s in points.stops(df.where(F.col("activity_id") == a)).orderBy("start_idx").collect()]
    assert not signs
    text = {(r.activity_id, r.code): r.text for r in insights.insight_rows(spark.createDataFrame([out[0]], analysis.analyse(df.withColumns({"wind_speed": F.lit(9.0), "wind_direction": F.lit(40.0)}), analysis.Plan.mode("deep")).schema)).collect()}
    assert text[0, "done"].startswith("Completed ") and (0, "pace") in text and (0, "np") not in text
    document = analysis.document(analysis.analyse(df, analysis.Plan.mode("quick"))).where("activity_id = 2").first()
    assert document.metadata.kind == "gravel" and document.detailed.sport_analysis.gravel.surface in ("smooth", "moderate", "rough", "very_rough") and "aero" not in document.detailed.asDict()
    plan = analysis.analyse(df, analysis.Plan.mode("normal"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # all analyses of all sports


def test_every_insight_rule(spark):
    from paceline.operators import insights

    empty = dict.fromkeys(("km", "moving_seconds", "speed", "gain", "watts", "hr", "hr_max", "hr_drift"))
    kinds = {"running": "struct<pace: double, cadence_stability: int, cadence_consistency: string>", "trail": "struct<gap: double>", "cycling": "struct<np: double, tss: int, best_vam: int>", "fatigue": "struct<detected: boolean, onset_km: double, severity: double>", "climbs": "array<struct<start_idx: int, km: double, grade: double, vam: double>>"}
    schema = ", ".join([*(f"{c} double" for c in empty), "kind string", *(f"{k} {v}" for k, v in kinds.items())])

    def said(**given):
        row = {**empty, "kind": "base", "running": None, "trail": None, "cycling": None, "fatigue": None, "climbs": [], **given}
        df = spark.createDataFrame([tuple(row.values())], schema)
        return {r["code"]: r["text"] for r in df.select(insights.insights({c: F.col(c) for c in df.columns}).alias("i")).first().i}

    assert said() == {}
    assert said(km=10.004, moving_seconds=3725.0, speed=9.96) == {"done": "Completed 10.00 km in 1h 2m 5s", "slow": "Average speed was 10.0 km/h"}
    assert said(speed=30.1) == {"quick": "Quick pace! Average speed was 30.1 km/h"} and said(speed=10.0) == {} and said(km=1.0, moving_seconds=59.0) == {"done": "Completed 1.00 km in 59s"}
    assert said(gain=501.0, km=10.0, moving_seconds=60.0)["gain"] == "Elevation gain of 501m (50.1m/km average gradient)" and "climbing" in said(gain=501.0) and set(said(gain=200.0)) == set()
    assert said(kind="running", running=(5.995, 81, "high")) == {"pace": "Average pace: 6:00/km", "cadence": "Cadence stability: 81% (high)"} and said(kind="hiking", running=(5.0, 81, "high")) == {}
    assert said(kind="trail", running=(5.5, None, None), trail=(6.25,)) == {"pace": "Average pace: 5:30/km", "gap": "Grade-adjusted pace (GAP) average: 6:15/km"}
    assert said(fatigue=(True, 3.25, 0.9)) == {"onset": "Fatigue detected at km 3.3", "severe": "Severe fatigue impact detected during the activity"} and list(said(fatigue=(True, 0.0, 0.6))) == ["moderate"] and said(fatigue=(False, 1.0, 0.9)) == {}
    assert said(kind="cycling", watts=200.4, cycling=(210.5, 55, 812)) == {"power": "Average power: 200W", "np": "Normalized power: 211W", "tss": "Training Stress Score (TSS): 55", "climb_vam": "Best VAM on climbs: 812 m/h"} and list(said(watts=1.0)) == ["power"]
    assert said(hr=150.0, hr_max=170.0, hr_drift=5.5) == {"hr": "Average heart rate: 150 bpm (max 170 bpm)", "drift": "Heart rate drift: +6% (signs of fatigue)"} and "steady" in said(hr=150.0, hr_max=170.0, hr_drift=-6.0) and "drift" not in said(hr=150.0, hr_max=170.0, hr_drift=5.4)
    assert said(climbs=[(5, 1.0, 6.0, None), (1, 2.0, 6.0, 700.4), (9, 3.0, 5.0, 900.0)]) == {"hardest": "Hardest climb: 2.00km at 6.0%", "vam": "Best VAM: 900 m/h"}


def test_predictions_are_worked_out_for_a_batch_of_states_at_a_time(spark):
    import numpy as np

    scores = [12.0, 33.3, 52.0, 79.9, None, -1.0, 0.0]
    for metres in (1609.0, 10000.0, 42195.0):
        want = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "k int, s double").orderBy("k").select(S.vdot_time(F.col("s"), F.lit(metres), P.NEWTON_STEPS)).collect()]
        got = P.times_at(np.array([np.nan if s is None else s for s in scores]), metres).tolist()
        assert [None if math.isnan(x) else x for x in got] == [None if x is None else pytest.approx(x, rel=1e-12) for x in want]
    plan = P.prediction_history(spark.createDataFrame(runs_of(5, 20), COLUMNS), ["athlete_id"])._jdf.queryExecution().optimizedPlan().toString()
    # predictions are numpy's, a row for each race is made after them, and the parts of a state are stacked: only training meets the periods in a join
    assert plan.count("MapInArrow") == 1 and "aggregate(" not in plan
    assert plan.index("Generate") < plan.index("MapInArrow") and plan.count("Join ") == 1
