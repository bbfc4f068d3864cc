import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import aggregates as G
from paceline.operators import analysers, enrich, load, points, windows

DAY = dt.date(2024, 1, 1)


def test_eddington_series_by_counting_every_threshold(spark):
    rng = random.Random(2)
    rows = [(a, DAY + dt.timedelta(days=d), rng.choice([0.4, 3.2, 7.9, 12.0, 30.0])) for a in (1, 2) for d in sorted(rng.sample(range(300), 60))] + [(3, DAY, 0.9)]
    got = {(r.a, r.threshold): r for r in G.eddington_series(spark.createDataFrame(rows, "a int, day date, total double"), ["a"]).collect()}
    for a in (1, 2):
        days = sorted((d, math.floor(t)) for x, d, t in rows if x == a)
        current, last = 0, days[-1][0]
        recent = [u for d, u in days if (last - d).days < 90]
        for t in range(1, max(u for _, u in days) + 1):
            r, reach = got.pop((a, t)), [k for k, (_, u) in enumerate(days) if u >= t]
            assert r.days == len(reach)
            if len(reach) >= t:
                current, k = t, reach[t - 1]
                assert (r.achieved, r.days_needed, r.active_days_needed, r.projected_active_days) == (days[k][0], (days[k][0] - days[0][0]).days + 1, k + 1, k + 1)
            else:
                q = sum(u >= t for u in recent)
                want = len(days) + math.ceil((t - len(reach)) * (len(recent) / q)) if t <= current + 10 and q else None
                assert (r.achieved, r.days_needed, r.projected_active_days) == (None, None, want)
    assert not got  # a key without a whole unit has no row


def test_pool_ties_follow_the_athletes_own_history(spark):
    # 100 m in 100 s fits 20, 25 and 50; each athlete's unambiguous swims settle it
    rows = [(1, 1, 100.0, 100), (2, 1, 75.0, 90), (3, 2, 100.0, 100), (4, 2, 40.0, 60), (5, 3, 100.0, 100), (6, 3, 0.0, 60), (7, 3, 100.0, None), (8, 3, 33.0, 40), (9, 3, None, 50), (10, 3, 100.0, 5)]
    df = spark.createDataFrame(rows, "id int, athlete_id int, distance double, moving_time int")
    got = {r.id: r.pool for r in enrich.with_pool(df, ["athlete_id"]).collect()}
    assert got == {1: "25", 2: "25", 3: "20", 4: "20", 5: "20", 6: None, 7: None, 8: None, 9: None, 10: None}
    mixed = {r.id: r.pool for r in enrich.with_pool(spark.createDataFrame([(1, 1, 1150.0, 1500), (2, 1, 46.0, 60), (3, 1, 230.0, 320)], df.schema), ["athlete_id"], enrich.MIXED_POOLS).collect()}
    assert mixed == {1: "25", 2: "25yd", 3: "25yd"}


def test_hrv_and_band_scores(spark):
    cases = [(55.0, 55.0, 50.0, 60.0), (40.0, 45.0, 50.0, 60.0), (70.0, None, 50.0, 60.0), (None, 55.0, 50.0, 60.0), (10.0, 90.0, 50.0, 51.0)]
    got = [r.s for r in spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, n double, a double, l double, h double").select("k", load.hrv_score(*(F.col(c) for c in "nalh")).alias("s")).orderBy("k").collect()]

    def plain(n, a, low, high):
        if n is None:
            return None
        width, a = max(6, high - low), n if a is None else a
        away = lambda v: max(low - v, v - high, 0)
        part = lambda v, s, p: 1 if away(v) == 0 else max(0.1, 1 - away(v) / (width * s + p))
        return max(0, min(1, part(a, 0.9, 8) * 0.5 + part(n, 0.75, 6) * 0.35 + max(0.35, 1 - abs(n - a) / (width + 10)) * 0.15))

    assert got == [pytest.approx(plain(*c)) for c in cases] and got[0] == 1.0
    bands = spark.range(1).select(*(load.band_score(F.lit(x), F.lit(50.0), F.lit(80.0)) for x in (50.0, 80.0, 0.0, 45.0, 500.0))).first()
    assert tuple(bands) == (1.0, 1.0, 0.28, pytest.approx(1 - 5 / (30 * 0.95 + 12)), 0.0)


def test_local_mean_widens_with_the_group(spark):
    rng = random.Random(6)
    series = {"short": [rng.random() for _ in range(7)], "long": [rng.random() for _ in range(130)], "one": [3.0]}
    rows = [(g, k, y) for g, ys in series.items() for k, y in enumerate(ys)]
    got = {(r.g, r.k): r.t for r in windows.local_mean(spark.createDataFrame(rows, "g string, k int, y double"), "y", ["g"], ["k"], "t").collect()}
    for g, ys in series.items():
        size = max(5, math.floor(len(ys) * 0.1))
        for i in range(len(ys)):
            near = range(max(0, i - size // 2), min(len(ys), i + size // 2 + 1))
            weight = [0 if abs(j - i) / (size / 2) >= 1 else (1 - (abs(j - i) / (size / 2)) ** 3) ** 3 for j in near]
            assert got[g, i] == pytest.approx(sum(w * ys[j] for w, j in zip(weight, near, strict=True)) / sum(weight))
    none = windows.local_mean(spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0)], "g string, k int, y double"), "y", ["g"], ["k"], "t").orderBy("k").collect()
    assert [r.t for r in none] == [pytest.approx(1.0 + 2 * w / (1 + w)) if k == 0 else None if k == 1 else pytest.approx(3.0 - 2 * w / (1 + w)) for k, w in ((k, (1 - 0.8**3) ** 3) for k in range(3))]


def test_power_measures(spark):
    rng = random.Random(9)
    tracks = {1: [float(rng.randrange(300)) for _ in range(70)], 2: [200.0] * 29, 3: [0.0, None, 100.0, 50.0]}
    df = spark.createDataFrame([(a, k, p) for a, ps in tracks.items() for k, p in enumerate(ps)], "activity_id int, idx int, power double")
    curve = {r.activity_id: r for r in points.power_curve(df).collect()}
    for a, ps in tracks.items():
        clean = [p or 0 for p in ps]
        for d in points.DURATIONS:
            want = max(sum(clean[k : k + d]) / d for k in range(len(clean) - d + 1)) if len(clean) >= d else None
            assert curve[a][f"best_{d}"] == (pytest.approx(want) if want is not None else None)
    np_ = {r.activity_id: r for r in points.normalised_power(df).collect()}
    means = [np.mean(tracks[1][k - 29 : k + 1]) ** 4 for k in range(29, 70)]
    assert np_[1].np == math.floor(np.mean(means) ** 0.25 + 0.5) and np_[2].np is None and np_[3].np is None and np_[2].p4_mean == 200.0 and np_[3].p4_mean == 75.0
    ahead = {r.activity_id: r["np"] for r in points.normalised_power_ahead(df).collect()}
    full = [np.mean([p for p in tracks[1][k : k + 30] if p > 0]) ** 4 for k in range(40)]
    assert ahead[1] == pytest.approx(np.mean(full) ** 0.25) and ahead[2] == 200.0 and ahead[3] == 75.0


def test_recursive_filters_against_plain_loops(spark):
    rng = random.Random(12)
    rows = [(1, k, dt.datetime(2024, 1, 1), rng.choice([8.0, 9.0, 60.0]), rng.choice([1.0, 2.0, -9.0]), rng.random() > 0.2, rng.choice([100.0, 101.0, 180.0])) for k in range(40)]
    df = spark.createDataFrame(rows, "activity_id int, idx int, ts timestamp, speed double, grade double, moving boolean, elevation double")
    got = points.cleaned(df.repartition(3)).orderBy("idx").collect()

    def hampel(x):
        x = list(x)
        for i in range(len(x)):
            near = sorted(x[max(0, i - 5) : i + 6])
            mid = near[len(near) // 2]
            mad = sorted(abs(v - mid) for v in near)[len(near) // 2]
            if mad > 0 and abs(x[i] - mid) > 2.5 * mad:
                x[i] = mid
        return x

    def smooth(x, width):
        x = list(x)
        for i in range(len(x)):
            near = x[max(0, i - width // 2) : i + width // 2 + 1]
            x[i] = sum(near) / len(near)
        return x

    assert [r.elevation_clean for r in got] == pytest.approx(smooth(hampel([r[6] for r in rows]), 5))
    assert [r.grade_smooth for r in got] == pytest.approx(smooth([r[4] for r in rows], 7))
    assert max(r.elevation_clean for r in got) < 180.0


def test_labels_trends_and_efforts(spark):
    days = [(dt.date(2024, 12, 30),), (dt.date(2025, 1, 5),), (dt.date(2024, 1, 1),), (dt.date(2023, 1, 1),)]
    assert [r[0] for r in spark.createDataFrame(days, "d date").select(S.week_label(F.col("d"))).collect()] == ["2024-W53", "2024-W53", "2024-W01", "2022-W52"]
    cases = [("pace", -1.0), ("pace", 1.0), ("distance", 1.0), ("distance", -1.0), ("hr", 0.0), ("hr", None)]
    assert [r[0] for r in spark.createDataFrame(cases, "m string, c double").select(S.trend(F.col("m"), F.col("c"))).collect()] == ["better", "worse", "better", "worse", "same", None]
    efforts = spark.createDataFrame([(1000.0, 300, 1, 1), (1000.0, 300, 3, 1), (1000.0, 300, None, 1), (1000.0, 300, 0, 7), (0.0, 300, None, None)], "distance double, moving_time int, pr_rank int, kom_rank int")
    assert [(r.pace, r["rank"]) for r in analysers.efforts_table(efforts).collect()] == [(5.0, "PR!"), (5.0, "PR #3"), (5.0, "KOM/QOM!"), (5.0, "Top 7"), (None, "")]


def test_percentiles_by_rank_equal_those_of_arrays(spark):
    rows = [(g, float(v)) for g in range(3) for v in random.Random(g).sample(range(1000), 1 + 17 * g)] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    rules = {"a": (0.8, "floor"), "b": (0.99, "floor1"), "c": (0.5, "nearest"), "d": (0.25, "linear")}
    want = df.where("v is not null").groupBy("g").agg(F.collect_list("v").alias("v")).select("g", *(G.percentile_by_rule(F.col("v"), *r).alias(n) for n, r in rules.items()))
    assert sorted(map(tuple, G.percentiles(df, ["g"], "v", rules).collect())) == sorted(map(tuple, want.collect()))


def test_modes_of_stacked_columns(spark):
    rows = [(DAY, "a", 1), (DAY, "a", 2), (DAY, "b", 2), (DAY, "b", 1), (DAY, None, 2), (DAY + dt.timedelta(days=40), None, None)]
    out = {r.period: r for r in G.by_period(spark.createDataFrame(rows, "day date, s string, v int"), "month", [], ["s", "v"]).collect()}
    one, two = out[DAY], out[dt.date(2024, 2, 1)]
    assert (one.n, one.s_mode, one.s_tied, one.v_mode, one.v_tied) == (5, "a", True, "2", False) and (two.s_mode, two.s_tied) == (None, False)


def test_features_and_confidence_of_classes(spark):
    from paceline.operators import classify

    rng = random.Random(21)
    zones = [(0.0, 120.0), (120.0, 150.0), (150.0, -1.0)]
    rows, km = [], 0.0
    for k in range(60):
        km += rng.choice([0.0, 0.05, 0.2])
        rows.append((1, k, km, 0 if k == 0 else 30, rng.choice([None, 110.0, 130.0, 170.0])))
    rows.append((2, 0, 5.0, 0, 140.0))
    samples = spark.createDataFrame(rows, "activity_id int, idx int, km double, d_time int, heart_rate double")
    got = {r.activity_id: r for r in classify.stream_features(samples, zones).collect()}
    own = [r for r in rows if r[0] == 1]
    steps = [(b[2] - a[2], b[3]) for a, b in zip(own, own[1:], strict=False) if b[2] > a[2]]
    cv = lambda v: float(np.std(v) / np.mean(v) * 100)
    paces = [t / 60 / d for d, t in steps if 2 <= t / 60 / d <= 20]
    half = next(30 * k for k, r in enumerate(own) if r[2] >= km / 2)
    rates = [r[4] for r in own if r[4]]
    timed = [r[4] for r in own[1:] if r[4]]
    one = got[1]
    assert (one.pace_cv, one.hr_cv, one.speed_cv) == (pytest.approx(cv(paces)), pytest.approx(cv(rates)), pytest.approx(cv([d / t for d, t in steps])))
    assert one.second_half == pytest.approx((59 * 30 - half) / half) and one.has_hr == (len(rates) >= 30) and one.has_pace == (len(paces) >= 30)
    assert [one.zone_low, one.zone_midlow, one.zone_midhigh, one.zone_high] == [pytest.approx(100 * sum(a <= h < b for h in timed) / len(timed)) for a, b in ((0, 120), (120, 150), (0, 0), (150, 999))]
    assert (got[2].pace_cv, got[2].hr_cv, got[2].second_half, got[2].has_zones) == (0.0, 0.0, None, False)
    acts = spark.createDataFrame([(1, "Tempo", "Run", 0, 15000.0, 3600, 3600, 200.0, 150.0), (2, None, "Run", None, 5000.0, 0, 0, None, None), (3, "x", "Run", 1, None, None, None, None, None)], "id int, name string, sport_type string, workout_type int, distance double, moving_time int, elapsed_time int, suffer_score double, average_heartrate double")
    told = {r.id: r for r in classify.classified(acts, samples, classify.RUN, zones).collect()}
    assert told[1].classes[0]["class"] == "Tempo Run" and told[1].confidence.missing == ([] if one.has_hr and one.has_pace else [m for m, there in (("heartrate stream", one.has_hr), ("training zones", one.has_hr), ("pace stream", one.has_pace)) if not there])
    assert told[3].classes[0]["class"] == "Race" and told[3].confidence.missing == ["heartrate stream", "training zones", "pace stream", "negative split"] and told[3].confidence.coverage == 10
    for r in told.values():
        points = [c.points for c in r.classes[:5]]
        lead = (points[0] - (points[1] if len(points) > 1 else 0)) / points[0]
        assert r.confidence.score == pytest.approx(math.floor(100 * min(0.99, max(0.05, 0.2 + 0.4 * lead + 0.3 * r.confidence.coverage / 100 + 0.1 * points[0] / sum(points))) + 0.5) / 100)
    none = classify.with_confidence(acts.where("id = 2").select("*", F.array().cast("array<struct<class: string, points: int, share: double>>").alias("classes"), *(F.lit(0.0).alias(c) for c in ("km", "minutes", "pace", "effort")), F.lit(False).alias("has_hr"), F.lit(False).alias("has_zones"), F.lit(None).cast("double").alias("second_half"), F.lit(False).alias("has_pace")), F.lit("Long Run")).first()
    assert [tuple(c) for c in none.classes] == [("Long Run", 100, 100.0)]
