"""Weather, equipment, cards, labels, matrices and analyses of whole tracks, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from paceline.functions import scalars as S
from paceline.operators import aggregates as G
from paceline.operators import analysers as N
from paceline.operators import cards as C
from paceline.operators import dates as D
from paceline.operators import enrich, weather as W
from paceline.operators import points as P
from paceline.plans.base import number, query
from paceline.plans.tracks import STEPS
from paceline.plans.training import DAILY, model
from paceline.sources import adapters as A


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: S.half_up(F.col(n), digits) for n in names})


# ---------------------------------------------------------------- weather

_JOINED = f"""{A.ACTIVITIES}, {A.WEATHER}, w AS (SELECT *, CAST(ts AS DATE) AS wday, row_number() OVER (PARTITION BY cell, CAST(ts AS DATE) ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY cell, CAST(ts AS DATE)) AS k FROM weather_hourly),
joined AS (SELECT a.id, a.day, w.* FROM activity a LEFT JOIN w ON w.cell = a.athlete_id % 20 AND w.wday = a.day
  AND w.place = coalesce((SELECT min(x.place) FROM w x WHERE x.cell = a.athlete_id % 20 AND x.wday = a.day AND hour(x.ts) = hour(a.start_ts)), least(hour(a.start_ts), w.k - 1)))"""


def _weathered(spark, sf_dir):
    a = A.activities(spark, sf_dir).withColumn("cell", F.col("athlete_id") % 20)
    return W.at_start(a, A.weather_hourly(spark, sf_dir), ["cell"])


@query(f"WITH {_JOINED} SELECT id, ts AS seen, temperature, wind_direction, weather_code FROM joined")
def weather_at_start(spark, sf_dir):
    return _weathered(spark, sf_dir).select("id", F.col("weather.ts").alias("seen"), "weather.temperature", "weather.wind_direction", "weather.weather_code")


_CONDITION = "CASE " + " ".join(f"WHEN weather_code = {k} THEN '{v}'" for k, v in W.GENERAL.items()) + " ELSE 'Unknown (' || weather_code || ')' END"
_KPIS = f"""{number('avg(temperature)', 1)} AS temperature, {number('avg(wind_speed)', 1)} AS wind, {number('avg(humidity)', 1)} AS humidity, {number('sum(precipitation)', 1)} AS rain, {number('avg(pressure)', 1)} AS pressure"""


def _kpis():
    mean = lambda c, n: S.half_up(F.avg(f"weather.{c}"), 1).alias(n)
    return [mean("temperature", "temperature"), mean("wind_speed", "wind"), mean("humidity", "humidity"), S.half_up(F.sum("weather.precipitation"), 1).alias("rain"), mean("pressure", "pressure")]


@query(f"WITH {_JOINED} SELECT CAST(month(day) AS INTEGER) AS month, count(*) AS n, {_KPIS} FROM joined WHERE ts IS NOT NULL GROUP BY 1")
def weather_months(spark, sf_dir):
    return _weathered(spark, sf_dir).where("weather is not null").groupBy(F.month("day").alias("month")).agg(F.count("*").alias("n"), *_kpis())


@query(f"""WITH {_JOINED}, c AS (SELECT *, {_CONDITION} AS condition FROM joined WHERE ts IS NOT NULL), m AS (SELECT condition FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), d AS (SELECT wind_direction FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {_KPIS}, (SELECT condition FROM m) AS condition, (SELECT wind_direction FROM d) AS wind_direction FROM c""")
def weather_kpis(spark, sf_dir):
    w = _weathered(spark, sf_dir).where("weather is not null").withColumn("condition", W.condition(F.col("weather.weather_code")))
    return w.agg(*_kpis(), W.modal("condition").alias("condition"), W.modal("weather.wind_direction").alias("wind_direction"))


@query(f"WITH {_JOINED} SELECT {_CONDITION} AS condition, count(*) AS n FROM joined WHERE ts IS NOT NULL GROUP BY 1")
def weather_conditions(spark, sf_dir):
    return _weathered(spark, sf_dir).where("weather is not null").groupBy(W.condition(F.col("weather.weather_code")).alias("condition")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- athletes


@query(f"""WITH {A.ZONES}, l AS (SELECT athlete_id, max AS top FROM zones WHERE zone = 5) SELECT c_custkey AS athlete_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN CAST(180 + c_custkey % 15 AS DOUBLE) END, CASE WHEN top > 0 THEN top END, 190) AS max_hr FROM customer LEFT JOIN l ON athlete_id = c_custkey""")
def max_hr_resolution(spark, sf_dir):
    last = A.zones(spark, sf_dir).groupBy("athlete_id").agg(F.max_by("max", "zone").alias("top"))
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("athlete_id"), F.when(F.col("c_custkey") % 3 == 0, (180 + F.col("c_custkey") % 15).cast("double")).alias("profile"))
    return c.join(last, "athlete_id", "left").select("athlete_id", C.max_heart_rate(F.col("profile"), F.col("top")).alias("max_hr"))


@query(f"""WITH {A.ZONES}, s AS (SELECT * FROM zones WHERE max > 0), e AS (SELECT athlete_id, arg_max(max, zone) - arg_min(min, zone) AS total, coalesce(max(CASE WHEN zone = 4 THEN min END), arg_max(min, zone)) AS ftp FROM s GROUP BY 1)
SELECT s.athlete_id, CAST(zone AS INTEGER) AS zone, {number('(max - min) * 100 / total', 4)} AS share, ftp FROM s JOIN e USING (athlete_id)""")
def zone_shares(spark, sf_dir):
    return rounded(C.last_closed_zone(A.zones(spark, sf_dir)).select("athlete_id", "zone", "share", "ftp"), 4, "share")


@query(f"""WITH {A.ACTIVITIES} SELECT id, CASE WHEN distance <> 0 AND average_heartrate / CAST(195 AS DOUBLE) BETWEEN 0.5 AND 1.2 THEN {number('(distance / moving_time * 60 * CAST(0.2 AS DOUBLE) + CAST(3.5 AS DOUBLE)) / (average_heartrate / CAST(195 AS DOUBLE))', 1)} END AS vo2max FROM activity""")
def vo2max_detail(spark, sf_dir):
    return A.activities(spark, sf_dir).select("id", S.half_up(C.vo2_at_pace(F.col("distance"), F.col("moving_time"), F.col("average_heartrate")), 1).alias("vo2max"))


@query(f"WITH {A.ACTIVITIES}, g AS (SELECT CASE WHEN id % 20 IN (0, 1) THEN 'solo' WHEN id % 20 = 2 THEN 'duo' WHEN id % 20 BETWEEN 3 AND 15 THEN 'small' ELSE 'large' END AS bucket, moving_time FROM activity) SELECT bucket, count(*) AS n, CAST(sum(moving_time) AS BIGINT) AS seconds FROM g GROUP BY 1")
def group_sizes(spark, sf_dir):
    return A.activities(spark, sf_dir).groupBy(C.group_bucket(F.col("id") % 20).alias("bucket")).agg(F.count("*").alias("n"), F.sum("moving_time").alias("seconds"))


# ---------------------------------------------------------------- swims, rides, runs

_SWIM = f"""{A.ACTIVITIES}, swim AS (SELECT *, distance / 1000 AS distance_km, CASE WHEN distance > 0 THEN moving_time / (distance / 100) END AS pace_sec100, CASE WHEN id % 4 = 0 OR id % 3 = 0 THEN 'pool' ELSE 'openwater' END AS swim_type FROM activity WHERE sport_type = 'Swim')"""


def _swims(spark, sf_dir):
    return C.swims(A.activities(spark, sf_dir).where("sport_type = 'Swim'").withColumns({"trainer": F.col("id") % 4 == 0, "has_start": F.col("id") % 3 != 0}))


@query(f"WITH {_SWIM} SELECT id, {number('distance_km', 4)} AS distance_km, {number('pace_sec100', 3)} AS pace_sec100, {number('pace_sec100 / 60', 4)} AS pace_min100, swim_type, {number('moving_time / CAST(elapsed_time AS DOUBLE)', 4)} AS moving_ratio FROM swim")
def swim_projection(spark, sf_dir):
    s = _swims(spark, sf_dir).select("id", "distance_km", "pace_sec100", "pace_min100", "swim_type", "moving_ratio")
    return rounded(rounded(s, 4, "distance_km", "pace_min100", "moving_ratio"), 3, "pace_sec100")


@query(f"WITH {_SWIM} SELECT swim_type, count(*) AS n, {number('sum(distance_km)', 2)} AS km, {number('avg(distance_km)', 3)} AS mean_km, {number('avg(pace_sec100 / 60)', 3)} AS pace, {number('avg(average_heartrate)', 2)} AS hr FROM swim GROUP BY 1")
def pool_and_open_water(spark, sf_dir):
    s = _swims(spark, sf_dir).groupBy("swim_type").agg(F.count("*").alias("n"), F.sum("distance_km").alias("km"), F.avg("distance_km").alias("mean_km"), F.avg("pace_min100").alias("pace"), F.avg("average_heartrate").alias("hr"))
    return rounded(rounded(s, 2, "km", "hr"), 3, "mean_km", "pace")


@query(f"""WITH {A.ACTIVITIES}, s AS (SELECT floor(distance / 25) * 25 AS d, moving_time AS t FROM activity WHERE sport_type = 'Swim'), c AS (SELECT list_filter([25, 33, 50], lambda m: d > 0 AND d % m = 0 AND t / (d / m) BETWEEN 15 AND 120) AS lengths FROM s)
SELECT lengths[1] || ' m' AS pool, count(*) AS n FROM c WHERE len(lengths) = 1 GROUP BY 1""")
def pool_length_counts(spark, sf_dir):
    s = A.activities(spark, sf_dir).where("sport_type = 'Swim'").withColumn("d", F.floor(F.col("distance") / 25).cast("double") * 25)
    found = enrich.pool_lengths(F.col("d"), F.col("moving_time"), [("25 m", 25.0), ("33 m", 33.0), ("50 m", 50.0)])
    return s.select(found.alias("c")).where("size(c) = 1").groupBy(F.col("c")[0].alias("pool")).agg(F.count("*").alias("n"))


_BIKES = ["road", "mtb", "gravel", "indoor", "electric"]
_BIKE = "CASE id % 5 WHEN 0 THEN 'mtb' WHEN 1 THEN 'gravel' WHEN 2 THEN 'electric' WHEN 3 THEN CASE WHEN id % 2 = 0 THEN 'indoor' ELSE 'road' END ELSE 'road' END"


def _rides(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("MountainBikeRide", "GravelRide", "EBikeRide", "Ride", "Ride"))), (F.col("id") % 5 + 1).cast("int"))
    a = A.activities(spark, sf_dir).where("sport_type = 'Ride'")
    return a.withColumn("bike", enrich.bike_type(F.lit(""), kind, (F.col("id") % 5 == 3) & (F.col("id") % 2 == 0)))


@query(f"""WITH {A.ACTIVITIES}, r AS (SELECT *, {_BIKE} AS bike FROM activity WHERE sport_type = 'Ride' AND id % 5 <> 2), t AS (SELECT unnest(['road', 'mtb', 'gravel', 'indoor', 'electric']) AS bike)
SELECT t.bike, count(id) AS n, {number('sum(distance) / 1000', 2)} AS km, {number('avg(distance) / 1000', 3)} AS mean_km, {number('avg((distance / 1000) / (moving_time / CAST(3600 AS DOUBLE)))', 3)} AS mean_speed, {number('avg(moving_time)', 1)} AS mean_seconds FROM t LEFT JOIN r ON t.bike = r.bike GROUP BY 1""")
def bike_types(spark, sf_dir):
    types = spark.createDataFrame([(b,) for b in _BIKES], "bike string")
    r = _rides(spark, sf_dir).where("bike <> 'electric'")
    g = r.groupBy("bike").agg(
        F.count("*").alias("n"), S.half_up(F.sum("distance") / 1000, 2).alias("km"), S.half_up(F.avg("distance") / 1000, 3).alias("mean_km"),
        S.half_up(F.avg((F.col("distance") / 1000) / (F.col("moving_time") / 3600.0)), 3).alias("mean_speed"), S.half_up(F.avg("moving_time"), 1).alias("mean_seconds"),
    )
    return types.join(g, "bike", "left").fillna(0, subset=["n"])


@query(f"WITH {A.ACTIVITIES} SELECT {_BIKE} AS bike, count(*) AS n FROM activity WHERE sport_type = 'Ride' GROUP BY 1")
def category_counts(spark, sf_dir):
    return _rides(spark, sf_dir).groupBy("bike").agg(F.count("*").alias("n"))


@query(f"""WITH {A.ACTIVITIES} SELECT sport_type, count(*) AS n, {number('sum(distance) / 1000', 2)} AS km, {number('sum(moving_time) / (sum(distance) / 1000)', 3)} AS pace_of_sums, {number('avg(moving_time / (distance / 1000))', 3)} AS mean_of_paces FROM activity WHERE distance > 0 AND sport_type IN ('Run', 'Ride', 'Swim') GROUP BY 1""")
def sport_cards(spark, sf_dir):
    a = A.activities(spark, sf_dir).where("distance > 0 and sport_type in ('Run', 'Ride', 'Swim')")
    return a.groupBy("sport_type").agg(
        F.count("*").alias("n"), S.half_up(F.sum("distance") / 1000, 2).alias("km"), S.half_up(F.sum("moving_time") / (F.sum("distance") / 1000), 3).alias("pace_of_sums"), S.half_up(F.avg(F.col("moving_time") / (F.col("distance") / 1000)), 3).alias("mean_of_paces"),
    )


# ---------------------------------------------------------------- periods and cards


@query(f"""WITH {A.HISTORY}, w AS (SELECT athlete_id, day + CAST(1 - dayofweek(day) AS INTEGER) AS week, sum(distance) AS d, sum(moving_time) AS t FROM history GROUP BY 1, 2) SELECT athlete_id, week, {number('d / 1000', 3)} AS km, CAST(t AS BIGINT) AS seconds, {number('t / (d / 1000)', 3)} AS pace FROM w WHERE d > 0""")
def sunday_weeks(spark, sf_dir):
    w = A.history(spark, sf_dir).groupBy("athlete_id", C.week_from_sunday(F.col("day")).alias("week")).agg(F.sum("distance").alias("d"), F.sum("moving_time").alias("seconds")).where("d > 0")
    return w.select("athlete_id", "week", S.half_up(F.col("d") / 1000, 3).alias("km"), "seconds", S.half_up(F.col("seconds") / (F.col("d") / 1000), 3).alias("pace"))


@query(f"WITH {A.ACTIVITIES} SELECT athlete_id, count(*) AS n, {number('sum(distance) / 1000', 2)} AS km, {number('sum(moving_time) / CAST(3600 AS DOUBLE)', 3)} AS hours, count(DISTINCT day) AS active_days, coalesce(sum(suffer_score), 0) AS tss FROM activity GROUP BY 1")
def period_summary(spark, sf_dir):
    return A.activities(spark, sf_dir).groupBy("athlete_id").agg(
        F.count("*").alias("n"), S.half_up(F.sum("distance") / 1000, 2).alias("km"), S.half_up(F.sum("moving_time") / 3600.0, 3).alias("hours"), F.countDistinct("day").alias("active_days"), F.coalesce(F.sum("suffer_score"), F.lit(0.0)).alias("tss"),
    )


@query(f"""WITH {A.ACTIVITIES} SELECT athlete_id, count(*) AS n, CAST(sum(moving_time) AS BIGINT) AS seconds, arg_max(id, (moving_time, -id)) AS longest, {', '.join(f"count(*) FILTER (sport_type = '{s}') AS {s.lower()}s" for s in ('Run', 'Ride', 'Swim'))} FROM activity GROUP BY 1""")
def top_line(spark, sf_dir):
    mix = [F.count_if(F.col("sport_type") == s).alias(f"{s.lower()}s") for s in ("Run", "Ride", "Swim")]
    return A.activities(spark, sf_dir).groupBy("athlete_id").agg(F.count("*").alias("n"), F.sum("moving_time").alias("seconds"), F.max_by("id", F.struct("moving_time", -F.col("id"))).alias("longest"), *mix)


_SPORTS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def _stacked_sql(period: str, step: str) -> str:
    return f"""WITH {A.HISTORY}, s AS (SELECT date_trunc('{period}', day)::DATE AS period, {', '.join(f"CAST(coalesce(sum(moving_time) FILTER (sport_type = '{k}'), 0) AS BIGINT) AS s{k[0]}" for k in _SPORTS)} FROM history GROUP BY 1),
p AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM s), (SELECT max(period) FROM s), INTERVAL {step})) AS DATE) AS period) SELECT p.period, {', '.join(f"coalesce(s{k[0]}, 0) AS s{k[0]}" for k in _SPORTS)} FROM p LEFT JOIN s ON p.period = s.period"""


def _stacked(spark, sf_dir, period):
    h = A.history(spark, sf_dir).withColumn("everyone", F.lit(1))
    return C.stacked(h, period, _SPORTS, F.col("moving_time"), ["everyone"]).select("period", *[F.col(f"`{k}`").alias(f"s{k[0]}") for k in _SPORTS])


@query(_stacked_sql("month", "1 MONTH"))
def stacked_months(spark, sf_dir):
    return _stacked(spark, sf_dir, "month")


@query(_stacked_sql("week", "7 DAY"))
def stacked_weeks(spark, sf_dir):
    return _stacked(spark, sf_dir, "week")


@query(f"WITH {A.HISTORY}, y AS (SELECT CAST(year(day) AS INTEGER) AS y, count(*) AS n, CAST(sum(moving_time) AS BIGINT) AS seconds FROM history GROUP BY 1) SELECT y, n, seconds, {number('n / CAST(max(n) OVER () AS DOUBLE)', 6)} AS n_scaled, {number('seconds / CAST(max(seconds) OVER () AS DOUBLE)', 6)} AS seconds_scaled FROM y")
def yearly_scaled(spark, sf_dir):
    y = A.history(spark, sf_dir).groupBy(F.year("day").alias("y")).agg(F.count("*").alias("n"), F.sum("moving_time").alias("seconds"))
    return y.withColumns({f"{c}_scaled": S.half_up(F.col(c) / F.max(c).over(Window.partitionBy(F.lit(1))), 6) for c in ("n", "seconds")})  # a row a year


def _grid_sql(table: str, name: str, row: str, column: str, values: range) -> str:
    return f"""WITH {table} SELECT CAST({row} AS INTEGER) AS "row", {', '.join(f'count(*) FILTER ({column} = {v}) AS c{v}' for v in values)} FROM {name} GROUP BY 1"""


def _grid(df, row, column, values):
    return G.matrix(df, row, column, list(values)).select("row", *[F.col(str(v)).alias(f"c{v}") for v in values])


@query(_grid_sql(A.HISTORY, "history", "isodow(day) - 1", "month(day)", range(1, 13)))
def weekday_month_matrix(spark, sf_dir):
    return _grid(A.history(spark, sf_dir), F.weekday("day"), F.month("day"), range(1, 13))


@query(_grid_sql(A.HISTORY, "history", "day(day)", "month(day)", range(1, 13)))
def monthday_month_matrix(spark, sf_dir):
    return _grid(A.history(spark, sf_dir), F.dayofmonth("day"), F.month("day"), range(1, 13))


@query(_grid_sql(A.HISTORY, "history", "year(day)", "isodow(day)", range(1, 8)))
def year_weekday_matrix(spark, sf_dir):
    return _grid(A.history(spark, sf_dir), F.year("day"), F.weekday("day") + 1, range(1, 8))


@query(_grid_sql(A.ACTIVITIES, "activity", "day(day)", "(hour(start_ts) - 2 + 24) % 24", range(24)))
def monthday_hour_matrix_shifted(spark, sf_dir):
    return _grid(A.activities(spark, sf_dir), F.dayofmonth("day"), C.shifted_hour(F.col("start_ts"), 2), range(24))


@query(_grid_sql(A.HISTORY, "history", "year(day)", "quarter(day)", range(1, 5)))
def year_quarter_matrix(spark, sf_dir):
    return _grid(A.history(spark, sf_dir), F.year("day"), F.quarter("day"), range(1, 5))


_AS_OF = date(1998, 6, 15)
_STARTS = {
    "week": "DATE '1998-06-15'", "last7": "DATE '1998-06-08'", "month": "DATE '1998-06-01'", "last30": "DATE '1998-05-16'", "last3m": "DATE '1998-03-15'", "last6m": "DATE '1997-12-15'",
    "year": "DATE '1998-01-01'", "last365": "DATE '1997-06-15'", "alltime": "DATE '1992-01-01'",
}


@query(f"WITH {A.HISTORY} SELECT {', '.join(f'''count(*) FILTER (day BETWEEN greatest({s}, DATE '1992-03-01') AND DATE '1998-06-10') AS {k}''' for k, s in _STARTS.items() if k != 'week')}, count(*) FILTER (day = DATE '1998-06-10') AS week FROM history")
def preset_windows(spark, sf_dir):
    spans = {k: D.window(k, _AS_OF, date(1992, 1, 1), date(1992, 3, 1), date(1998, 6, 10)) for k in D.PRESETS}
    return A.history(spark, sf_dir).agg(*[F.count_if(F.col("day").between(*map(F.lit, span))).alias(k) for k, span in spans.items()])


@query(f"WITH {A.ACTIVITIES} SELECT id, athlete_id FROM activity WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND sport_type IN ('Ride') AND polyline IS NOT NULL")
def map_viewport(spark, sf_dir):
    return A.activities(spark, sf_dir).where("day between date'2024-01-03' and date'2024-01-25' and sport_type in ('Ride') and polyline is not null").select("id", "athlete_id")


_XY = "moving_time / (distance / 1000)"


@query(f"WITH {A.ACTIVITIES} SELECT id, sport_type AS series, {number('distance / 1000', 4)} AS x, {number(_XY, 3)} AS y FROM activity WHERE distance > 0 AND moving_time > 0 AND isfinite({_XY})")
def pace_scatter(spark, sf_dir):
    y = S.ratio(F.col("moving_time").cast("double"), F.col("distance") / 1000)
    a = A.activities(spark, sf_dir).where((F.col("distance") > 0) & (F.col("moving_time") > 0) & y.isNotNull() & (F.abs(y) < float("inf")))
    return a.select("id", F.col("sport_type").alias("series"), S.half_up(F.col("distance") / 1000, 4).alias("x"), S.half_up(y, 3).alias("y"))


@query(f"WITH {A.POINTS} SELECT activity_id, to_json({{'samples': count(*), 'moving': count(*) FILTER (moving), 'last_idx': max(idx)}}) AS document FROM point GROUP BY 1")
def result_document(spark, sf_dir):
    doc = F.to_json(F.struct(F.count("*").alias("samples"), F.count_if("moving").alias("moving"), F.max("idx").alias("last_idx")))
    return A.points(spark, sf_dir).groupBy("activity_id").agg(doc.alias("document"))


@query(f"WITH {A.ACTIVITIES} SELECT id, suffer_score AS tss FROM activity WHERE suffer_score IS NOT NULL ORDER BY suffer_score DESC, id LIMIT 10")
def top10_by_load(spark, sf_dir):
    return A.activities(spark, sf_dir).where("suffer_score is not null").orderBy(F.desc("suffer_score"), "id").limit(10).select("id", F.col("suffer_score").alias("tss"))


@query(f"WITH {A.HISTORY} SELECT id, day FROM history ORDER BY day DESC, id DESC LIMIT 30")
def latest_30(spark, sf_dir):
    return A.history(spark, sf_dir).orderBy(F.desc("day"), F.desc("id")).limit(30).select("id", "day")


@query("""WITH k AS (SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS name FROM part) SELECT name, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM k""")
def pretty_keys(spark, sf_dir):
    k = A.table(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name")).distinct()
    return k.withColumn("label", F.initcap(F.replace("name", F.lit("_"), F.lit(" "))))


@query("""SELECT p_partkey AS id, TRY_CAST(replace(CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE p_size || '%' END, '%', '') AS DOUBLE) AS value FROM part""")
def percent_numbers(spark, sf_dir):
    shown = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("%")))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace(shown, F.lit("%"), F.lit("")).try_cast("double").alias("value"))


@query(f"WITH {A.HISTORY} SELECT isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0') AS week, count(*) AS n FROM history GROUP BY 1")
def iso_weeks(spark, sf_dir):
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("day")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0"))
    return A.history(spark, sf_dir).groupBy(label.alias("week")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- equipment

_PARTS = "parts AS (SELECT p_partkey AS gear_id, p_brand AS brand, p_name AS name, CASE WHEN p_size > 25 THEN p_size END AS frame_type, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END AS weight FROM part)"


def _parts(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gear_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("frame_type"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice")).alias("weight"))


@query(f"""WITH {A.GEAR_USES}, {_PARTS}, g AS (SELECT gear_id, count(*) AS uses, count(*) FILTER (grade > CAST(0.05 AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS trail FROM gear_use GROUP BY 1)
SELECT p.gear_id, CASE WHEN frame_type IS NOT NULL OR weight IS NOT NULL THEN 'bike' ELSE 'shoe' END AS kind, CASE WHEN trail > CAST(0.3 AS DOUBLE) THEN 'trail' ELSE 'road' END AS shoe_type FROM parts p JOIN g USING (gear_id)""")
def gear_kinds(spark, sf_dir):
    g = A.gear_uses(spark, sf_dir).groupBy("gear_id").agg((F.count_if(F.col("grade") > 0.05) / F.count("*")).alias("trail"))
    return _parts(spark, sf_dir).join(g, "gear_id").select("gear_id", C.gear_kind(F.col("frame_type"), F.col("weight")).alias("kind"), C.shoe_type(F.col("trail")).alias("shoe_type"))


@query(f"""WITH {A.GEAR_USES}, {_PARTS}, g AS (SELECT gear_id, sum(km) AS km, max(day) AS last_use FROM gear_use GROUP BY 1)
SELECT gear_id, brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY km DESC, gear_id) AS INTEGER) AS by_km, CAST(row_number() OVER (PARTITION BY brand ORDER BY last_use DESC, gear_id) AS INTEGER) AS by_last_use, CAST(row_number() OVER (PARTITION BY brand ORDER BY name, gear_id) AS INTEGER) AS by_name FROM g JOIN parts USING (gear_id)""")
def gear_order(spark, sf_dir):
    g = A.gear_uses(spark, sf_dir).groupBy("gear_id").agg(F.sum("km").alias("km"), F.max("day").alias("last_use")).join(_parts(spark, sf_dir), "gear_id")
    place = lambda *by: F.row_number().over(Window.partitionBy("brand").orderBy(*by, "gear_id"))
    return g.select("gear_id", "brand", place(F.desc("km")).alias("by_km"), place(F.desc("last_use")).alias("by_last_use"), place("name").alias("by_name"))


@query(f"WITH {A.GEAR_USES} SELECT gear_id, date_trunc('month', day)::DATE AS month, sum(km) AS km, count(*) AS n FROM gear_use GROUP BY 1, 2")
def gear_by_month(spark, sf_dir):
    return A.gear_uses(spark, sf_dir).groupBy("gear_id", G.period_start(F.col("day"), "month").alias("month")).agg(F.sum("km").alias("km"), F.count("*").alias("n"))


@query(f"WITH {A.GEAR_USES} SELECT gear_id, day, sum(km) AS km FROM gear_use GROUP BY 1, 2")
def gear_by_day(spark, sf_dir):
    return A.gear_uses(spark, sf_dir).groupBy("gear_id", "day").agg(F.sum("km").alias("km"))


@query(f"WITH {A.GEAR_USES}, g AS (SELECT gear_id, sum(km) AS km, count(*) AS n FROM gear_use GROUP BY 1) SELECT count(*) AS pieces, sum(km) AS km, CAST(sum(n) AS BIGINT) AS uses, count(*) FILTER (km >= 800 AND gear_id % 9 <> 0) AS to_replace FROM g")
def gear_fleet(spark, sf_dir):
    g = A.gear_uses(spark, sf_dir).groupBy("gear_id").agg(F.sum("km").alias("km"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("pieces"), F.sum("km").alias("km"), F.sum("n").alias("uses"), F.count_if((F.col("km") >= 800) & (F.col("gear_id") % 9 != 0)).alias("to_replace"))


@query(f"""WITH {A.GEAR_USES}, g AS (SELECT gear_id, count(*) AS n, sum(km) AS km, min(day) AS first_use, max(day) AS last_use, max(km) AS best_km FROM gear_use GROUP BY 1), d AS (SELECT gear_id, isodow(day) - 1 AS v, count(*) AS k FROM gear_use GROUP BY 1, 2), f AS (SELECT gear_id, CAST(arg_min(v, (-k, v)) AS INTEGER) AS weekday FROM d GROUP BY 1)
SELECT gear_id, n, km, {number('km / n', 3)} AS mean_km, greatest(1, date_diff('day', first_use, last_use)) AS span_days, {number("km / greatest(1, greatest(1, date_diff('day', first_use, last_use)) / CAST(7 AS DOUBLE))", 3)} AS km_week, best_km, weekday FROM g JOIN f USING (gear_id)""")
def gear_detail(spark, sf_dir):
    u = A.gear_uses(spark, sf_dir)
    g = u.groupBy("gear_id").agg(F.count("*").alias("n"), F.sum("km").alias("km"), F.min("day").alias("a"), F.max("day").alias("b"), F.max("km").alias("best_km"))
    span = F.greatest(F.lit(1), F.datediff("b", "a"))
    own = g.join(C.favourite(u, F.weekday("day"), "weekday"), "gear_id")
    return own.select("gear_id", "n", "km", S.half_up(F.col("km") / F.col("n"), 3).alias("mean_km"), span.cast("long").alias("span_days"), S.half_up(F.col("km") / F.greatest(F.lit(1.0), span / 7.0), 3).alias("km_week"), "best_km", "weekday")


@query(f"WITH {A.GEAR_USES} SELECT id, line, km FROM gear_use WHERE gear_id = 7")
def gear_filter(spark, sf_dir):
    wanted = "7"
    u = A.gear_uses(spark, sf_dir)
    return (u if wanted == "all" else u.where(F.col("gear_id") == int(wanted))).select("id", "line", "km")


# ---------------------------------------------------------------- labels and readiness

_LABELS = f"""m AS (SELECT athlete_id, day, {number('load / 100', 2)} AS load, {number('atl / 100', 2)} AS atl, {number('ctl / 100', 2)} AS ctl, {number('tsb / 100', 2)} AS tsb FROM model), r AS (SELECT *, cume_dist() OVER (PARTITION BY athlete_id ORDER BY ctl) AS rank, greatest(10, ctl * 7) AS base FROM m),
b AS (SELECT *, base * CAST(1.10 AS DOUBLE) - base * CAST(0.85 AS DOUBLE) < 20 AS narrow, (base * CAST(0.85 AS DOUBLE) + base * CAST(1.10 AS DOUBLE)) / 2 AS mid FROM r), e AS (SELECT *, {number('greatest(0, CASE WHEN narrow THEN mid - 10 ELSE base * CAST(0.85 AS DOUBLE) END)', 1)} AS lower, {number('CASE WHEN narrow THEN mid + 10 ELSE base * CAST(1.10 AS DOUBLE) END', 1)} AS upper FROM b)"""


@query(f"""WITH {A.ACTIVITIES}, {DAILY}, {_LABELS} SELECT athlete_id, day, lower, upper,
CASE WHEN rank >= 0.9 THEN 'Peak fitness' WHEN rank >= 0.7 THEN 'High fitness' WHEN rank >= 0.45 THEN 'Productive' WHEN rank >= 0.25 THEN 'Maintaining' ELSE 'Rebuilding' END AS ctl_label,
CASE WHEN atl - ctl >= 22 THEN 'Strained' WHEN atl - ctl >= 12 THEN 'Overload' WHEN atl - ctl >= 4 THEN 'Build' WHEN atl - ctl > -6 THEN 'Productive' ELSE 'Recovery' END AS atl_label,
CASE WHEN tsb <= -30 THEN 'Strained' WHEN tsb <= -15 THEN 'Heavy load' WHEN tsb <= 5 THEN 'Productive' WHEN tsb <= 15 THEN 'Race-ready' WHEN tsb <= 23 THEN 'Recovery' ELSE 'Underload' END AS tsb_label,
CASE WHEN load < lower - greatest(8, (upper - lower) * CAST(0.08 AS DOUBLE)) THEN 'Below range' WHEN load > upper + greatest(8, (upper - lower) * CAST(0.08 AS DOUBLE)) THEN 'Above range' ELSE 'In range' END AS band_label FROM e""")
def load_labels(spark, sf_dir):
    m = model(spark, sf_dir).dropna(subset=["load", "atl", "ctl", "tsb", "ramp"]).select("athlete_id", "day", *[S.half_up(F.col(c) / 100, 2).alias(c) for c in ("load", "atl", "ctl", "tsb")])
    rank = F.cume_dist().over(Window.partitionBy("athlete_id").orderBy("ctl"))
    lower, upper = C.load_band(F.col("ctl"))
    e = m.withColumns({"rank": rank, "lower": lower, "upper": upper})
    return e.select(
        "athlete_id", "day", "lower", "upper", C.ctl_label(F.col("rank")).alias("ctl_label"), C.atl_label(F.col("atl") - F.col("ctl")).alias("atl_label"),
        C.tsb_label(F.col("tsb"), -30.0, -15.0, 5.0, 15.0).alias("tsb_label"), C.band_label(F.col("load"), F.col("lower"), F.col("upper")).alias("band_label"),
    )


@query(f"""WITH {A.ACTIVITIES}, d AS (SELECT athlete_id, day, count(*) AS n FROM activity GROUP BY 1, 2), {A.HRV}
SELECT d.athlete_id, d.day, n, nightly, CASE WHEN least(n * 30, 100) >= 90 THEN 'Excellent' WHEN least(n * 30, 100) >= 75 THEN 'Very Good' WHEN least(n * 30, 100) >= 60 THEN 'Good' WHEN least(n * 30, 100) >= 40 THEN 'Fair' ELSE 'Poor' END AS label FROM d LEFT JOIN hrv h ON d.athlete_id = h.athlete_id AND d.day = h.day""")
def hrv_by_day(spark, sf_dir):
    d = A.activities(spark, sf_dir).groupBy("athlete_id", "day").agg(F.count("*").alias("n"))
    return d.join(A.hrv(spark, sf_dir).select("athlete_id", "day", "nightly"), ["athlete_id", "day"], "left").withColumn("label", C.readiness_label(F.least(F.col("n") * 30, F.lit(100))))


# ---------------------------------------------------------------- whole tracks

_WATTS = "CASE WHEN speed > 0 THEN greatest(0, 75 * CAST(9.81 AS DOUBLE) * (grade / 100) * (speed / CAST(3.6 AS DOUBLE)) + 75 * CAST(9.81 AS DOUBLE) * CAST(0.004 AS DOUBLE) * (speed / CAST(3.6 AS DOUBLE)) + CAST(0.5 AS DOUBLE) * CAST(1.225 AS DOUBLE) * CAST(0.35 AS DOUBLE) * (speed / CAST(3.6 AS DOUBLE)) * (speed / CAST(3.6 AS DOUBLE)) * (speed / CAST(3.6 AS DOUBLE))) ELSE 0 END"


@query(f"WITH {A.POINTS}, w AS (SELECT activity_id, {_WATTS} AS watts FROM point) SELECT activity_id, {number('avg(watts)', 3)} AS power_avg, {number('max(watts)', 3)} AS power_max FROM w WHERE watts > 0 GROUP BY 1")
def estimated_power(spark, sf_dir):
    w = A.points(spark, sf_dir).select("activity_id", N.estimated_power(F.col("speed"), F.col("grade")).alias("watts")).where("watts > 0")
    return rounded(w.groupBy("activity_id").agg(F.avg("watts").alias("power_avg"), F.max("watts").alias("power_max")), 3, "power_avg", "power_max")


_WIND = "w AS (SELECT *, abs(CAST(idx * 37 % 360 AS DOUBLE) - 90) AS gap FROM point), c AS (SELECT *, 15 * cos(radians(CASE WHEN gap > 180 THEN 360 - gap ELSE gap END)) AS wind FROM w)"


@query(f"""WITH {A.POINTS}, {_WIND} SELECT activity_id, CAST(idx AS INTEGER) AS idx, {number('wind', 4)} AS wind, {number('greatest(0, CAST(0.5 AS DOUBLE) * CAST(1.225 AS DOUBLE) * CAST(0.3 AS DOUBLE) * (speed / CAST(3.6 AS DOUBLE) + wind / CAST(3.6 AS DOUBLE)) * (speed / CAST(3.6 AS DOUBLE) + wind / CAST(3.6 AS DOUBLE)) * (speed / CAST(3.6 AS DOUBLE)))', 3)} AS drag, {number('60 / greatest(CAST(0.1 AS DOUBLE), speed + wind / 10)', 4)} AS pace FROM c""")
def wind_and_drag(spark, sf_dir):
    wind = N.wind_component((F.col("idx") * 37 % 360).cast("double"), 90.0, 15.0)
    c = A.points(spark, sf_dir).withColumn("wind", wind)
    return c.select("activity_id", "idx", S.half_up(F.col("wind"), 4).alias("wind"), S.half_up(N.drag_power(F.col("speed"), F.col("wind")), 3).alias("drag"), S.half_up(N.wind_adjusted_pace(F.col("speed"), F.col("wind")), 4).alias("pace"))


@query(f"WITH {A.POINTS} SELECT activity_id, {number('avg(60 / (speed / exp(grade / 100 * CAST(0.05 AS DOUBLE))))', 3)} AS gap FROM point WHERE moving AND speed > 0 GROUP BY 1")
def grade_adjusted_pace(spark, sf_dir):
    p = A.points(spark, sf_dir).where("moving and speed > 0")
    return p.groupBy("activity_id").agg(S.half_up(F.avg(N.grade_adjusted_pace(F.col("speed"), F.col("grade"))), 3).alias("gap"))


@query(f"""WITH {A.POINTS}, d AS (SELECT *, elevation - lag(elevation) OVER (PARTITION BY activity_id ORDER BY idx) AS climb FROM point), s AS (SELECT *, climb / step_m * 100 >= 3 AND climb > 0 AS up, max(idx) OVER (PARTITION BY activity_id) AS last FROM d WHERE idx > 0 AND step_m >= 5),
f AS (SELECT *, CASE WHEN up AND NOT coalesce(lag(up) OVER (PARTITION BY activity_id ORDER BY idx), false) THEN 1 ELSE 0 END AS st FROM s), i AS (SELECT *, sum(st) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT activity_id, CAST(min(idx) - 1 AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, {number('sum(climb)', 3)} AS gain, sum(step_m) AS metres FROM i WHERE up GROUP BY activity_id, island HAVING max(idx) < max(last) AND sum(step_m) / 1000 >= CAST(0.01 AS DOUBLE) AND sum(climb) >= 1 AND sum(climb) / sum(step_m) * 100 >= 3""")
def stream_climbs(spark, sf_dir):
    c = N.stream_climbs(A.points(spark, sf_dir), 0.01, 1.0)
    return c.select("activity_id", "start_idx", "end_idx", S.half_up(F.col("gain"), 3).alias("gain"), "metres")


@query(f"""WITH {A.POINTS}, {STEPS}, t AS (SELECT *, CASE WHEN abs(grade) > 8 THEN 'technical' WHEN grade > 2 THEN 'climb' WHEN grade < -2 THEN 'descent' ELSE 'flat' END AS terrain FROM k),
n AS (SELECT *, CASE WHEN terrain <> lag(terrain) OVER o OR km - lag(km) OVER o > CAST(0.0105 AS DOUBLE) THEN 1 ELSE 0 END AS new FROM t WINDOW o AS (PARTITION BY activity_id ORDER BY idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY activity_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS segment FROM n)
SELECT activity_id, min(terrain) AS terrain, CAST(min(idx) AS INTEGER) AS start_idx, CAST(max(idx) AS INTEGER) AS end_idx, {number('max(km) - min(km)', 4)} AS km, {number('sum(greatest(climb, 0))', 3)} AS gain, count(*) AS n FROM g GROUP BY activity_id, segment""")
def terrain_segments(spark, sf_dir):
    s = N.terrain_segments(A.points(spark, sf_dir), P.terrain(F.col("grade")), 0.0105)
    return rounded(rounded(s.select("activity_id", "terrain", "start_idx", "end_idx", "km", "gain", "n"), 4, "km"), 3, "gain")


@query(f"""WITH {A.POINTS}, {STEPS}, t AS (SELECT *, max(km) OVER (PARTITION BY activity_id) AS total FROM k), w AS (SELECT activity_id, s.range AS k, min(km) AS a, max(km) AS b, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM t JOIN range(2000) s ON km >= s.range * CAST(0.02 AS DOUBLE) AND km <= s.range * CAST(0.02 AS DOUBLE) + CAST(0.05 AS DOUBLE) AND s.range * CAST(0.02 AS DOUBLE) < total - CAST(0.05 AS DOUBLE) GROUP BY 1, 2),
v AS (SELECT activity_id, k, (b - a) / ((t1 - t0) / CAST(3600000000 AS DOUBLE)) AS speed FROM w WHERE t1 > t0 AND b > a) SELECT activity_id, CAST(arg_min(k, (-speed, k)) AS INTEGER) AS fastest_k, {number('max(speed)', 6)} AS fastest, CAST(arg_min(k, (speed, k)) AS INTEGER) AS slowest_k, {number('min(speed)', 6)} AS slowest FROM v GROUP BY 1""")
def best_stretches(spark, sf_dir):
    return rounded(N.best_stretch(A.points(spark, sf_dir), 0.05, 0.02), 6, "fastest", "slowest")


@query(f"""WITH {A.POINTS}, n AS (SELECT *, CASE WHEN speed > 0 THEN 60 / speed END AS pace, idx >= floor(count(*) OVER (PARTITION BY activity_id) / CAST(2 AS DOUBLE)) AS late FROM point), h AS (SELECT activity_id, avg(pace) FILTER (moving) AS pace, sum(pace) FILTER (NOT late) / nullif(count(*) FILTER (NOT late), 0) AS a, sum(pace) FILTER (late) / count(*) FILTER (late) AS b FROM n GROUP BY 1)
SELECT activity_id, {number('pace', 3)} AS pace, {number('a', 3)} AS first_half, {number('b', 3)} AS second_half, b > a AS positive_split FROM h""")
def pace_halves(spark, sf_dir):
    return rounded(N.pace_halves(A.points(spark, sf_dir)), 3, "pace", "first_half", "second_half")


@query(f"""WITH {A.POINTS}, s AS (SELECT activity_id, power, row_number() OVER (PARTITION BY activity_id ORDER BY power, idx) - 1 AS r, count(*) OVER (PARTITION BY activity_id) AS n FROM point WHERE power > 0), q AS (SELECT activity_id, max(power) FILTER (r = floor(n * CAST(0.25 AS DOUBLE))) AS q1, max(power) FILTER (r = floor(n * CAST(0.75 AS DOUBLE))) AS q3 FROM s GROUP BY 1),
f AS (SELECT s.activity_id, floor(avg(power) + 0.5) AS mean, max(power) AS most, count(*) FILTER (power BETWEEN q1 AND q3) * CAST(100 AS DOUBLE) / count(*) AS share FROM s JOIN q ON s.activity_id = q.activity_id GROUP BY 1 HAVING count(*) >= 2)
SELECT activity_id, CAST(mean AS BIGINT) AS mean, most, {number('share', 3)} AS share, CASE WHEN share > 80 THEN 'high' WHEN share > 60 THEN 'moderate' ELSE 'low' END AS consistency FROM f""")
def cadence_steadiness(spark, sf_dir):
    return rounded(N.steadiness(A.points(spark, sf_dir), "power"), 3, "share")


@query(f"""WITH {A.POINTS}, p AS (SELECT activity_id, CASE WHEN heart_rate > 0 THEN heart_rate END AS h, CASE WHEN power > 0 THEN power END AS w FROM point) SELECT activity_id, {number('avg(h)', 3)} AS hr, max(h) AS hr_max, min(h) AS hr_min, {number('stddev_pop(h)', 4)} AS hr_sd, {number('count(*) FILTER (h >= 160) * CAST(100 AS DOUBLE) / nullif(count(h), 0)', 3)} AS above_pct, {number('avg(w)', 3)} AS watts, max(w) AS watts_max, {number('avg(w) / avg(h)', 5)} AS watts_a_beat FROM p GROUP BY 1""")
def physiology_blocks(spark, sf_dir):
    return rounded(rounded(rounded(N.physiology(A.points(spark, sf_dir)), 3, "hr", "above_pct", "watts"), 4, "hr_sd"), 5, "watts_a_beat")


@query(f"""WITH {A.LAPS}, p AS (SELECT *, seconds / nullif(km, 0) AS pace FROM laps), e AS (SELECT *, stddev_samp(pace) OVER w / avg(pace) OVER w AS pcv, stddev_samp(heart_rate) OVER w / avg(heart_rate) OVER w AS hcv FROM p WINDOW w AS (PARTITION BY activity_id))
SELECT activity_id, lap, {number('pace', 3)} AS pace, {number('strokes / (km * 1000)', 5)} AS strokes_m, {number('pcv', 5)} AS pace_cv, {number('hcv', 5)} AS hr_cv, {number('CASE WHEN max(pace) OVER w > min(pace) OVER w THEN (pace - min(pace) OVER w) / (max(pace) OVER w - min(pace) OVER w) ELSE CAST(0.5 AS DOUBLE) END', 5)} AS colour FROM e WINDOW w AS (PARTITION BY activity_id)""")
def laps_table(spark, sf_dir):
    own = N.laps_table(A.laps(spark, sf_dir)).withColumn("colour", N.scaled(F.col("pace"), ["activity_id"]))
    return rounded(rounded(own.select("activity_id", "lap", "pace", "strokes_m", "pace_cv", "hr_cv", "colour"), 3, "pace"), 5, "strokes_m", "pace_cv", "hr_cv", "colour")


@query(f"WITH {A.POINTS} SELECT activity_id, CAST(idx AS INTEGER) AS idx, {', '.join(f'''{number(f'avg({c}) OVER (PARTITION BY activity_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 3)} AS {c}''' for c in ('grade', 'power', 'step_m'))} FROM point")
def smoothed_streams(spark, sf_dir):
    from paceline.operators.windows import centred_mean

    means = [S.half_up(centred_mean(c, 2, 2, ["activity_id"], ["idx"]), 3).alias(c) for c in ("grade", "power", "step_m")]
    return A.points(spark, sf_dir).select("activity_id", "idx", *means)
