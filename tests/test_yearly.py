import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import annual, points

AS_OF = dt.date(2024, 3, 10)


@pytest.mark.parametrize("text, want", [
    ("2024-02-29", (2024, 2, 29)), ("2023-02-29", None), ("2024/2/3", (2024, 2, 3)), ("3.2.2024", (2024, 2, 3)), ("2-13-24", (2024, 2, 13)), ("13/2/24", (2024, 2, 13)), ("  5   Febrero ", (2024, 2, 5)), ("Août 7, 2023", (2023, 8, 7)), ("Dec. 24", (2023, 12, 24)),
    ("9 april", (2024, 4, 9)), ("10 abril", (2023, 4, 10)), ("30 sept 2022", (2022, 9, 30)), ("31 june", None), ("soon", None), ("", None), (None, None), ("12", None), ("32/1/2024", None),
])
def test_loose_days(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(S.loose_day(F.col("t"), F.lit(AS_OF))).first()[0]
    assert got == (dt.date(*want) if want else None)


def activities(spark, rows):
    return spark.createDataFrame(rows, "athlete_id int, id int, day date, start_ts timestamp, sport_type string, distance double, moving_time int, total_elevation_gain double, athlete_count int")


def test_annual_report(spark):
    rng, rows = random.Random(3), []
    for k in range(80):
        start = dt.datetime(2022, 12, 1, rng.randrange(24)) + dt.timedelta(days=rng.randrange(420))
        rows.append((k % 2, k, start.date(), start, rng.choice(["Run", "Ride", "Swim", "Yoga", None, "Hike"]), rng.choice([None, 1000.0, 5000.0, 12000.0]), rng.choice([None, 0, 1200, 4000]), rng.choice([None, 30.0, 400.0]), rng.choice([None, 1, 2])))
    rows += [(0, 900 + d, dt.date(2023, 12, 31 - d), dt.datetime(2023, 12, 31 - d, 9), "Run", 3000.0, 900, 0.0, 1) for d in range(4)] + [(7, 999, dt.date(2022, 5, 1), dt.datetime(2022, 5, 1), "Run", 1.0, 1, 1.0, 1)]
    got = {r.athlete_id: r for r in annual.annual_report(activities(spark, rows), ["athlete_id"], 2023).collect()}
    assert set(got) == {0, 1}
    for a, r in got.items():
        now, last = ([x for x in rows if x[0] == a and x[2].year == y] for y in (2023, 2022))
        total = lambda part, k: sum(x[k] or 0 for x in part)
        assert (r.n, r.distance, r.seconds, r.elevation, r.active_days) == (len(now), total(now, 5), total(now, 6), total(now, 7), len({x[2] for x in now}))
        assert r.distance_change == (pytest.approx((total(now, 5) - total(last, 5)) * 100 / total(last, 5)) if total(last, 5) else None)
        hours = lambda held: pytest.approx(sum((x[6] or 0) / 3600 for x in now if held(x)))  # noqa: E731, B023
        assert list(r.month_hours) == [hours(lambda x, m=m: x[2].month == m) for m in range(1, 13)] and list(r.weekday_hours) == [hours(lambda x, d=d: x[2].weekday() == d) for d in range(7)]
        assert (r.part_hours.night, r.part_hours.evening) == (hours(lambda x: x[3].hour < 6), hours(lambda x: x[3].hour >= 18))
        assert (r.category_hours.run, r.category_hours.gym, r.category_hours.other) == (hours(lambda x: x[4] == "Run"), hours(lambda x: x[4] == "Yoga"), hours(lambda x: x[4] in (None, "Hike")))
        longest = min(((-x[5], x[1]) for x in now if x[5] is not None))
        assert (r.longest.value, r.longest.id) == (-longest[0], longest[1])
        fast = min(((x[6] / (x[5] / 1000), x[1]) for x in now if x[4] == "Run" and (x[5] or 0) >= 3000 and (x[6] or 0) > 0), default=None)
        assert (r.fastest_run.value, r.fastest_run.id) == ((pytest.approx(fast[0]), fast[1]) if fast else (None, None))
        days, best, run = sorted({x[2] for x in now}), 0, 0
        for k, d in enumerate(days):
            run = run + 1 if k and (d - days[k - 1]).days == 1 else 1
            best = max(best, run)
        assert r.longest_streak == best and r.current_streak == (run if days[-1] == dt.date(2023, 12, 31) else 0)
        weeks = {}
        for x in now:
            w = x[2] - dt.timedelta(days=x[2].weekday())
            weeks[w] = weeks.get(w, 0) + (x[5] or 0) / 1000
        assert (r.top_week.start, r.top_week.km) == min(weeks.items(), key=lambda i: (-i[1], i[0]))
        told = [x[8] for x in now if x[8] is not None]
        assert r.solo_share == pytest.approx(told.count(1) * 100 / len(told)) and sum(s.n for s in r.sports) == len(now)


def test_record_stats_fall_back_and_shift(spark):
    rows = [(1, 1, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 1), "Run", 900.0, 100, None, 1), (1, 2, dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 0, 30), "Run", 800.0, 80, 5.0, 2), (1, 3, dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 1), None, None, None, 5.0, None)]
    r = annual.record_stats(activities(spark, rows), ["athlete_id"], -2).first()
    assert (r.n, r.longest.id, r.fastest.id, r.most_elevation.id, r.span_days, r.favourite_hour, r.favourite_weekday) == (3, 1, 2, 2, 2, 23, 2)
    assert r.mean_pace == pytest.approx((1000 / 9 / 60 + 1000 / 10 / 60) / 3) and r.solo_share == pytest.approx(100 / 3) and r.group_share == pytest.approx(200 / 3)
    assert annual.record_stats(activities(spark, [*rows, (1, 4, dt.date(2024, 1, 4), dt.datetime(2024, 1, 4), "Run", 1001.0, 400, 0.0, 1)]), ["athlete_id"]).first().fastest.id == 4


def test_segments_share_their_borders(spark):
    rows = [(1, k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * k), 10.0 + k, float(k % 5 * 3 - 4), True, float(k), 0.0 if k == 0 else 100.0, 0.0 if k == 3 else 120.0 + k, None, 80.0) for k in range(11)]
    df = spark.createDataFrame(rows, "activity_id int, idx int, ts timestamp, speed double, grade double, moving boolean, elevation double, step_m double, heart_rate double, power double, cadence double")
    half = {r.segment: r for r in points.segments(df, "distance", 0.5).collect()}
    assert {k: (r.start_idx, r.end_idx, r["name"]) for k, r in half.items()} == {0: (0, 5, "0.0-0.5 km"), 1: (5, 10, "0.5-1.0 km")}
    one = half[0]
    assert (one.km, one.seconds, one.gain, one.avg_speed, one.max_speed, one.avg_hr, one.max_hr, one.avg_power, one.terrain, one.vam) == (pytest.approx(0.5), 300, 5.0, 12.5, 15.0, pytest.approx((120 + 121 + 122 + 124 + 125) / 5), 125.0, 0.0, "descent", pytest.approx(60.0))
    timed = {r.segment: (r.start_idx, r.end_idx, r["name"]) for r in points.segments(df, "time", 4.0).collect()}
    assert timed == {0: (0, 4, "0-4 min"), 1: (4, 8, "4-8 min"), 2: (8, 10, "8-12 min")}
    z = points.zone_percents(df).first()
    assert [z[f"hr_{k}"] for k in range(1, 6)] == [0, 100, 0, 0, 0] or sum(z[f"hr_{k}"] for k in range(1, 6)) in (99, 100, 101)
    assert [z[f"power_{k}"] for k in range(1, 7)] == [0] * 6
