"""Small hand-made cases, each against a plain loop."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import aggregates as G
from paceline.operators import enrich, joins, load, points, windows
from paceline.operators.query import ActivityQuery

DAY = dt.date(2024, 1, 1)


def days(spark, values, athlete=1):
    rows = [(athlete, DAY + dt.timedelta(days=k), float(v), 1) for k, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "athlete_id long, day date, load double, n long")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_fatigue_counts_active_days_only(spark):
    got = load.fitness_and_fatigue(days(spark, [10, None, None, 20, 60])).orderBy("day").collect()
    assert [r.atl for r in got] == [10, 15, 30]
    assert [r.ramp for r in got] == [0, 5, 15]
    dense = load.fitness_and_fatigue(days(spark, [10, None, None, 20, 60]), calendar=True).orderBy("day").collect()
    assert [r.atl for r in dense] == [10, 5, 10 / 3, 7.5, 18]


def test_empty_table_gives_empty_model(spark):
    assert load.fitness_and_fatigue(days(spark, [])).count() == 0
    assert load.risk(load.fitness_and_fatigue(days(spark, []))).count() == 0


def test_exponential_mean_is_the_recursion(spark):
    values = [5.0, 1.0, 8.0, 3.0]
    got = [r.e for r in load.exponential(days(spark, values), "load", 7, "e").orderBy("day").collect()]
    want, now = [], 0.0
    for v in values:
        now += (v - now) / 7
        want.append(now)
    assert got == pytest.approx(want)


def test_risk_of_constant_load_and_smoothing(spark):
    model = load.fitness_and_fatigue(days(spark, [50] * 8))
    raw = [r.raw_risk for r in load.raw_risk(model).orderBy("day").collect()]
    got = [r.risk for r in load.risk(model).orderBy("day").collect()]
    want = raw[:1]
    for x in raw[1:]:
        a = 0.2 + 0.5 * min(1, abs(x - want[-1]))
        want.append(np.floor((want[-1] * (1 - a) + x * a) * 1000 + 0.5) / 1000)
    assert got == pytest.approx(want)


def test_readiness_moves_at_most_eight_points(spark):
    dense = load.stability(load.seven_day_load(load.fitness_and_fatigue(days(spark, [10, 300, None, 5, 5, 400, 1]))))
    got = [r.readiness for r in load.readiness(dense).orderBy("day").collect()]
    assert all(abs(b - a) <= 8 + 1e-9 for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(
    ("row", "method", "tss"),
    [
        ((0, 150.0, 5.0), "none", 0.0), ((3600, 190.0, 5.0), "heartrate", 107.0), ((3600, None, 50.0), "suffer_score", 53.5), ((3600, None, None), "time", 38.52), ((18000, 95.0, None), "heartrate", 127.06),
    ],
)
def test_stress_branches(spark, row, method, tss):
    df = spark.createDataFrame([(1, "Run", *row)], "id long, sport_type string, moving_time long, average_heartrate double, suffer_score double")
    got = load.stress(df).first()
    assert got.tss_method == method
    assert got.tss == pytest.approx(tss)


def test_stress_zones_outside_all_take_the_last_weight(spark):
    df = spark.createDataFrame([(1, "Run", 3600, 50.0, None), (2, "Run", 3600, 250.0, None)], "id long, sport_type string, moving_time long, average_heartrate double, suffer_score double")
    got = [r.tss for r in load.stress(df, [(100.0, 150.0), (150.0, 200.0)]).orderBy("id").collect()]
    assert got == pytest.approx([112.35, 112.35])


def test_eddington_by_definition(spark):
    totals = [3.2, 3.0, 3.9, 1.0, 0.4, 10.0]
    df = spark.createDataFrame([(1, DAY + dt.timedelta(days=k), v) for k, v in enumerate(totals)], "athlete_id long, day date, total double")
    assert G.eddington(df, ["athlete_id"]).first().eddington == max(e for e in range(11) if sum(int(t) >= e for t in totals) >= e)
    steps = {r.threshold: (r.days, r.achieved) for r in G.eddington_steps(df, ["athlete_id"]).collect()}
    assert steps[3] == (4, DAY + dt.timedelta(days=2))
    assert steps[10] == (1, None)


def test_streaks_cross_the_year(spark):
    at = [dt.date(2023, 12, 30), dt.date(2023, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 5)]
    df = spark.createDataFrame([(1, d) for d in at], "athlete_id long, day date")
    assert sorted(r.length for r in G.streaks(df, ["athlete_id"]).collect()) == [1, 3]
    assert [r.length for r in G.streaks(df, ["athlete_id"], "week").collect()] == [2]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (None,)], "x double")
    assert [r.n for r in G.histogram(df, F.col("x"), 0.0, 5.0, 2).orderBy("bin").collect()] == [1, 1]
    assert [r.n for r in G.histogram(df, F.col("x"), 0.0, 5.0, 2, clamped=True).orderBy("bin").collect()] == [1, 2]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [tuple(r) for r in G.ten_bins(flat, "x").collect()] == [(0, 2)]


def test_percentile_rules(spark):
    v = F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)])
    assert [one(spark, G.percentile_by_rule(v, 0.5, r)) for r in ("floor", "floor1", "nearest", "linear")] == [3, 2, 3, 2.5]
    assert one(spark, G.percentile_by_rule(F.array().cast("array<double>"), 0.5, "floor")) is None


def test_quadratic_fit_matches_polyfit(spark):
    rng = np.random.default_rng(1)
    km = rng.uniform(1, 40, 30)
    y = 3 + 2 * np.log(km) + 0.5 * np.log(km) ** 2 + rng.normal(0, 0.1, 30)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(km, y, strict=True)], "k long, km double, y double")
    got = G.quadratic_in_log(df, F.col("km"), F.col("y"), ["k"]).first()
    assert [got.c, got.b, got.a] == pytest.approx(np.polyfit(np.log(km), y, 2), rel=1e-4)
    assert G.quadratic_in_log(df.limit(2), F.col("km"), F.col("y"), ["k"]).first().a is None


def test_transitions_edges(spark):
    t = dt.datetime(2024, 1, 1, 8)
    rows = [(1, 1, "Swim", t, 3600), (2, 1, "Ride", t + dt.timedelta(hours=3), 3600), (3, 1, "Ride", t + dt.timedelta(hours=4), 60), (4, 1, "Run", t + dt.timedelta(minutes=30), 60)]
    df = spark.createDataFrame(rows, "id long, athlete_id long, sport_type string, start_ts timestamp, elapsed_time long")
    got = sorted((r.a, r.b) for r in joins.transitions(df, 7200, ["athlete_id"]).collect())
    start = {i: s for i, _, _, s, _ in rows}
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[2] != b[2] and 0 <= (start[b[0]] - a[3]).total_seconds() - a[4] <= 7200)
    assert got == want


def test_nearest_takes_the_earlier_of_two(spark):
    t = dt.datetime(2024, 1, 1, 8, 30)
    left = spark.createDataFrame([(1, 1, t), (2, 2, t)], "id long, k long, ts timestamp")
    right = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 8), 5.0), (1, dt.datetime(2024, 1, 1, 9), 6.0)], "k long, seen timestamp, v double")
    assert {r.id: r.v for r in joins.nearest(left, right, ["k"], "ts", "seen", ["v"]).collect()} == {1: 5.0, 2: None}


def test_split_border_belongs_to_both(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, k, t + dt.timedelta(seconds=k), 500.0 if k else 0.0, 1.0, 0.0, 0.0, 100.0) for k in range(5)]
    df = spark.createDataFrame(rows, "activity_id long, idx int, ts timestamp, step_m double, speed double, grade double, elevation double, heart_rate double")
    assert [(r.split, r.n) for r in points.splits(df).orderBy("split").collect()] == [(0, 3), (1, 3)]


def test_hampel_in_place_differs_from_parallel():
    x = np.array([0, 0, 1, 0, 9, 9, 0, 1, 0, 9, 0, 0, 1, 0, 5.0])
    a, b = points.hampel(x), points.hampel(x, in_place=False)
    assert a[4] == b[4] == 1
    assert not np.isnan(a).any()
    assert points.hampel(np.array([1.0, np.nan])).tolist()[0] == 1.0


def test_spikes_use_the_repaired_sample_before():
    steps, lat, _ = points.without_spikes(np.array([0, 0.5, 0.5, 0.02, 0.4]), np.array([0.0, 8.0, 4.0, 2.0, 9.0]), np.zeros(5))
    assert steps.tolist() == [0, 0.25, pytest.approx(0.135), 0.02, 0.02]
    assert lat.tolist() == [0.0, 2.0, 2.0, 2.0, 2.0]


def test_smoothing_of_moving_samples():
    got = points.smooth_moving(np.array([1.0, 0.0, 3.0, 5.0]), np.array([True, True, False, True]), 3)
    assert got.tolist() == [1.0, 0.0, 3.0, 5.0]
    # each mean is taken over what is already replaced, without the sample that stands still
    changed = points.smooth_moving(np.array([2.0, 4.0, 9.0, 6.0]), np.array([True, True, False, True]), 3)
    assert changed.tolist() == [3.0, 3.5, 9.0, 6.0]


def test_power_curve_is_the_best_window(spark):
    p = [1.0, 5.0, 2.0, 9.0, 4.0]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(p)], "activity_id long, idx int, power double")
    got = points.power_curve(df, [1, 2, 6]).first()
    assert (got.best_1, got.best_2, got.best_6) == (9.0, 6.5, None)


def test_islands_partition_the_rows(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1]
    df = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate(flags)], "a long, i long, f boolean")
    sizes = [r["count"] for r in windows.islands(df, F.col("f"), ["a"], "i").groupBy("island").count().orderBy("island").collect()]
    assert sizes == [2, 1, 2]


def test_streams_become_points(spark):
    df = spark.createDataFrame([(7, [1, 2, 3], [5.0, 6.0])], "activity_id long, time array<int>, watts array<double>")
    assert [tuple(r) for r in points.from_streams(df, ["time", "watts"]).collect()] == [(7, 0, 1, 5.0), (7, 1, 2, 6.0), (7, 2, 3, None)]


def test_polyline(spark):
    got = one(spark, S.decoded_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [tuple(p) for p in got] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert one(spark, S.decoded_polyline(F.lit(""))) == []


@pytest.mark.parametrize(("text", "value"), [("1,5", 1.5), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("45 ms", 45.0), ("x", None), (None, None)])
def test_loose_numbers(spark, text, value):
    assert one(spark, S.loose_number(F.lit(text).cast("string"))) == value


def test_loose_range_and_texts(spark):
    assert tuple(one(spark, S.loose_range(F.lit("45-60")))) == (45.0, 60.0)
    assert one(spark, S.clock(F.lit(3725.4))) == "1:02:05"
    assert one(spark, S.pace_text(F.lit(4.9999))) == "5:00"
    assert one(spark, S.folded(F.lit("  Élan "))) == "elan"
    assert [one(spark, S.half_up(F.lit(x))) for x in (2.5, -0.5)] == [3.0, 0.0]


def test_vdot_inverse(spark):
    score = one(spark, S.vdot(F.lit(10000.0), F.lit(2400.0)))
    assert one(spark, S.vdot_time(F.lit(score), F.lit(10000.0))) == pytest.approx(2400, rel=1e-6)


def test_wind_and_bearing(spark):
    assert one(spark, S.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(90)
    assert [one(spark, S.wind_relation(F.lit(90.0), F.lit(w))) for w in (270.0, 90.0, 0.0)] == ["tail", "head", "cross"]


def test_pool_lengths_and_correction(spark):
    assert one(spark, enrich.pool_lengths(F.lit(100.0), F.lit(100.0), [("20", 20), ("25", 25), ("50", 50)])) == ["20", "25", "50"]
    acts = spark.createDataFrame([(1, 1, DAY, 100.0), (2, 2, DAY, 100.0)], "id long, athlete_id long, day date, distance double")
    fix = spark.createDataFrame([(1, DAY, 1.1, "fixed")], "athlete_id long, until_day date, factor double, tag string")
    assert {r.id: (round(r.distance, 6), r.tag) for r in enrich.corrected(acts, fix).collect()} == {1: (110.0, "fixed"), 2: (100.0, None)}


def test_adhoc_nulls(spark):
    df = spark.createDataFrame([(1, "Run", DAY, None, None), (2, "Run", DAY, 5000.0, 100.0)], "id long, sport_type string, day date, distance double, average_heartrate double")
    assert ActivityQuery(distance_km=(0, 10)).filtered(df).count() == 2
    assert ActivityQuery(heart_rate=(None, 200)).filtered(df).count() == 1
    assert ActivityQuery(period="month", order_by="n", columns=("period", "n")).run(df.drop("id")).first().n == 2


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
