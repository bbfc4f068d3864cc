import datetime as dt
import json
from xml.etree import ElementTree

from pyspark.sql import functions as F

from paceline.operators import classify
from paceline.sources import readers, writers
from paceline.streaming import daily


def test_activity_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"id": 1, "athlete": {"id": 9}, "type": "Run", "start_date_local": "2024-01-02T23:59:00", "distance": 5000.5, "map": {"summary_polyline": "??"}}, {"id": 2, "sport_type": "Ride"}]))
    got = {r.id: r for r in readers.activities(spark, str(tmp_path)).collect()}
    assert (got[1].athlete_id, got[1].sport_type, got[1].day, got[1].distance) == (9, "Run", dt.date(2024, 1, 2), 5000.5)
    assert got[2].sport_type == "Ride" and got[2].day is None


def test_recovery_export(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿Fecha;Overnight HRV;Baseline;7d Avg\n01/02/2024;45 ms;45 - 60;50,5\n2024-02-03;;40-50;\n01/02/2024;47;45-60;51\nnever;1;2;3\n", encoding="utf-8")
    got = {r.day: tuple(r)[1:] for r in readers.recovery_csv(spark, str(path)).collect()}
    assert got == {dt.date(2024, 2, 1): (47.0, 45.0, 60.0, 51.0), dt.date(2024, 2, 3): (None, 40.0, 50.0, None)}


def test_gpx_leaves_out_points_without_position(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, 0.0, 5.0, t, 1.0, 100.0, None), (1, 0, 10.0, 5.0, t, 1.0, 100.0, 5.0), (1, 2, 11.0, 6.0, t, None, None, None)]
    points = spark.createDataFrame(rows, "activity_id long, idx int, lat double, lon double, ts timestamp, elevation double, heart_rate double, power double")
    text = writers.gpx(points, spark.createDataFrame([(1, "a<b")], "activity_id long, name string")).first().gpx
    assert text.count("<trkpt") == 2 and "a&lt;b" in text and text.index('lat="10.0') < text.index('lat="11.0')
    root = ElementTree.fromstring(text)
    space = {"g": "http://www.topografix.com/GPX/1/1"}
    assert root.find("g:metadata/g:name", space).text == "a<b"
    first, second = root.findall("g:trk/g:trkseg/g:trkpt", space)
    assert (first.find("g:ele", space).text, first.find("g:extensions/g:power", space).text, first.find("g:extensions/g:heartrate", space).text) == ("1.00", "5.0", "100.0")
    assert second.find("g:ele", space) is None and len(second.find("g:extensions", space)) == 0


def test_profiles_equipment_zones_and_weather(spark, tmp_path):
    docs = {
        "a/1": {"id": 9, "firstname": "Ann", "weight": 60.5}, "g/1": {"id": "b1", "name": "Road", "distance": 1000.0, "retired": False}, "g/2": {"message": "Not Found"},
        "z/1": {"heart_rate": {"custom_zones": False, "zones": [{"min": 0, "max": 120}, {"min": 120, "max": -1}]}},
        "w/1": {"latitude": 1.5, "longitude": 2.5, "hourly": {"time": ["2024-01-02T00:00", "2024-01-02T01:00"], "rain": [0.5]}}, "w/2": {"error": True},
    }
    for name, doc in docs.items():
        (tmp_path / name[0]).mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    at = lambda k: str(tmp_path / k)
    assert [(r.id, r.firstname, r.weight) for r in readers.athletes(spark, at("a")).collect()] == [(9, "Ann", 60.5)]
    assert [(r.id, r.distance, r.retired) for r in readers.gears(spark, at("g")).collect()] == [("b1", 1000.0, False)]
    assert sorted(tuple(r) for r in readers.zones(spark, at("z")).collect()) == [("heart_rate", 1, 0.0, 120.0), ("heart_rate", 2, 120.0, None)]
    assert sorted(tuple(r) for r in readers.hourly_weather(spark, at("w"), ["rain"]).collect()) == [(1.5, 2.5, dt.datetime(2024, 1, 2), 0.5), (1.5, 2.5, dt.datetime(2024, 1, 2, 1), None)]


def test_csv_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.005, None), (1, 1, 2.5, 3.0)], "activity_id long, idx int, speed double, power double")
    writers.points_csv(df, str(tmp_path / "p"), {"speed": 1, "power": 0})
    assert [tuple(r) for r in spark.read.option("header", "true").csv(str(tmp_path / "p")).orderBy("idx").collect()] == [("1", "0", "1.0", None), ("1", "1", "2.5", "3")]
    writers.snapshot(df, str(tmp_path / "s"), "v1", "2024-01-01 00:00:00")
    assert readers.snapshot(spark, str(tmp_path / "s"), "v1", "2024-01-01 00:30:00", 1).count() == 2
    assert readers.snapshot(spark, str(tmp_path / "s"), "v2", "2024-01-01 00:30:00", 1).count() == 0
    assert readers.snapshot(spark, str(tmp_path / "s"), "v1", "2024-01-01 02:00:00", 1).count() == 0


def test_synthetic_is_seeded(spark):
    a, b = (readers.synthetic(spark, 50).agg(F.sum("distance")).first()[0] for _ in range(2))
    assert a == b


def test_rules_against_a_plain_loop(spark):
    acts = readers.synthetic(spark, 60).withColumns({"name": F.lit("Tempo on the road"), "suffer_score": (F.col("id") * 5).cast("double"), "total_elevation_gain": F.col("id") * 10.0, "workout_type": (F.col("id") % 3).cast("int")})
    for rules in (classify.RUN, classify.BIKE):
        out = classify.scored(classify.features(acts), rules)
        conditions = [c for g in rules for c, _ in g]
        flags = out.select("classes", F.array(*[F.coalesce(F.expr(c), F.lit(False)) for c in conditions]).alias("f")).collect()
        for r in flags:
            held, points = iter(r.f), {}
            for group in rules:
                hits = [next(held) for _ in group]
                if True in hits:
                    for c, d in group[hits.index(True)][1].items():
                        points[c] = points.get(c, 0) + d
            want = sorted(((-p, c) for c, p in points.items() if p > 0))
            assert [(-x["points"], x["class"]) for x in r.classes] == want


def test_stream_of_days_equals_the_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 8)
    df = spark.createDataFrame([(k, 1, t + dt.timedelta(hours=9 * k), 10.0) for k in range(8)], "id long, athlete_id long, start_ts timestamp, tss double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = daily.daily_load(stream).writeStream.outputMode("complete").format("memory").queryName("days").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.day, r.load) for r in spark.table("days").collect()}
    assert got == {(r.day, r.load) for r in df.groupBy(F.to_date("start_ts").alias("day")).agg(F.sum("tss").alias("load")).collect()}
    assert daily.weekly_load(df).count() > 0
    assert daily.sessions(df, "10 hours").count() == 1
