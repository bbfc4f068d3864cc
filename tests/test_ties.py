"""Values that lie just on a threshold or a tie of rounding, where noise of running sums must not decide."""

import datetime as dt

from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import classify, sports


def test_half_of_the_way_just_reached_counts(spark):
    rows = []
    for who in range(60):
        steps, km = [(who * 7 + k * k) % 13 for k in range(12)], 0.0
        steps = [0, *steps, *steps[::-1]]
        for k, s in enumerate(steps):
            km += s * 20 / 1000
            rows.append((who, k, km, 60 if k else 0, None))
    points = spark.createDataFrame(rows, "activity_id long, idx long, km double, d_time int, heart_rate double")
    assert {r.second_half for r in classify.stream_features(points).collect()} <= {1.0} | {(24 - k) / k for k in range(1, 12) for who in range(60) if (who * 7 + k * k) % 13 == 0}


def test_gain_on_a_tie_is_rounded_up(spark):
    # 0.16 km and climbs of hundredths of a metre: the gain a km lies just between two thousandths
    rows = []
    for who in range(40):
        parts = [(who * 13 + k * 29) % 97 / 100 + 0.01 for k in range(19)]
        parts.append(round(50.01 + 0.02 * who - sum(parts), 2))
        up = 0.0
        for k, p in enumerate([0.0, *parts]):
            up = round(up + p, 2)
            rows.append((who, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), 5.0, 4.0, True, up, 0.0 if k == 0 else 8.0, 100.0, 100.0, 80.0, 0.0))
    points = spark.createDataFrame(rows, "activity_id long, idx long, ts timestamp, speed double, grade double, moving boolean, elevation double, step_m double, heart_rate double, power double, cadence double, bearing double")
    got = sports.analysed(points, kinds=("hiking",), fatigue=False).select("activity_id", S.half_up(F.col("hiking.gain_a_km"), 3).alias("g")).collect()
    for r in got:
        gain = 5001 + 2 * r.activity_id  # hundredths of a metre over 0.16 km: gain / 16 to thousandths, half up
        assert r.g == ((gain * 1000 * 2 + 16) // 32) / 1000


def test_braking_on_a_tie_is_rounded_as_the_sql_rounds_it(spark, tmp_path):
    import duckdb

    from paceline.plans import registry, sporting  # noqa: F401

    # two events each, 48 seconds apart: the change of speed lies just between two ten-thousandths
    rows = []
    for who, n in enumerate((351, 369, 405, 471, 483)):
        for up in (0, 1):
            for k, v in enumerate((0.0, n / 100) if up else (n / 100, 0.0)):
                rows.append((4 * who + 2 * up + k, dt.datetime(2024, 1, 1, 0, 0, 48 * k), 2 * who + up, "view", v))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    columns = ["activity_id", "brakings", "braking", "bursts", "burst"]
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLES['gravel_braking']}) order by 1").fetchall()
    got = registry.QUERIES["gravel_braking"](spark, str(tmp_path)).select(columns).orderBy("activity_id").collect()
    assert [tuple(r) for r in got] == want


def told_by_both(spark, folder, rows, name, columns):
    """Rows of a query over ``rows`` of events and of its SQL."""
    import duckdb

    from paceline.plans import registry

    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = con.execute(f"select {columns} from ({registry.ORACLES[name]}) order by all").fetchall()
    return [tuple(r) for r in registry.QUERIES[name](spark, str(folder)).selectExpr(*columns.split(", ")).orderBy(*columns.split(", ")).collect()], want


def test_a_sport_without_heart_rates_has_a_dash(spark, tmp_path):
    # every fifth event has no heart rate: one athlete's runs have none at all
    rows = [(k, dt.datetime(2024, 1, 2, 3, k), u, kind, 50.0) for k, u, kind in ((0, 1, "click"), (5, 1, "click"), (1, 1, "view"), (10, 2, "signup"), (12, 2, "signup"))]
    got, want = told_by_both(spark, tmp_path, rows, "coach_context", "athlete_id, sports")
    assert got == want == [(1, "Run 2 -, Ride 1 111"), (2, "TrailRun 2 122")]


def test_rides_without_distance_have_a_fastest(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, day), 1, "view", 0.0) for k, day in ((7, 3), (3, 5))]
    got, want = told_by_both(spark, tmp_path, rows, "coach_context", "athlete_id, fastest_ride_day, longest_run_day")
    assert got == want == [(1, dt.date(2024, 1, 5), None)]


def test_insights_of_a_track_without_distance(spark, tmp_path):
    # steps of every thirteenth event are zero: metres climbed have no mean per km
    rows = [(13 * k, dt.datetime(2024, 1, 2, 3, k), 1, "view", 30000.0 * (k % 2)) for k in range(1, 4)]
    got, want = told_by_both(spark, tmp_path, rows, "activity_insights", "activity_id, priority, code, text")
    assert got == want and (1, 6, "gain", None) in got
