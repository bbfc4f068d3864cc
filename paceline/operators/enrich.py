"""Per-row columns that need nothing but the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import ratio


def environment(df: DataFrame) -> DataFrame:
    """Difficulty 0 to 100 from temperature, humidity with heat, wind, rain and pressure; a missing measure adds nothing."""
    t, h = F.col("temperature"), F.col("humidity")
    heat = F.when(t > 20, (t - 20) / 20.0 * ((h - 50) / 50.0) * 10).otherwise(0.0)
    parts = [
        F.least(F.lit(40.0), (t - 15) * (t - 15) / 15.625), F.when(h > 50, F.least(F.lit(25.0), (h - 50) / 50.0 * 15 + heat)), F.least(F.lit(20.0), F.col("wind_speed") / 30.0 * 20),
        F.least(F.lit(10.0), F.col("precipitation") * 2), F.least(F.lit(5.0), F.abs(F.col("pressure") - 1013) / 40.0 * 5),
    ]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return df.withColumn("difficulty", F.least(F.floor(total + 0.5), F.lit(100)).cast("int"))


def moving_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("moving_ratio", F.when(F.col("elapsed_time") > 0, F.col("moving_time") / F.col("elapsed_time")))


def pool_lengths(distance: Column, seconds: Column, lengths: list[tuple[str, float]], least: float = 15.0, most: float = 120.0) -> Column:
    """Labels of the pool lengths that divide the distance and are swum in a plausible time each."""
    options = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(float(m)).alias("m")) for n, m in lengths])
    each = lambda o: seconds / (distance / o["m"])
    return F.transform(F.filter(options, lambda o: (distance > 0) & (distance % o["m"] == 0) & (each(o) >= least) & (each(o) <= most)), lambda o: o["label"])


#: Pools by name, their length in metres (yards rounded), and the plausible seconds for a length.
METRIC_POOLS = (("20", 20.0, 15.0, 120.0), ("25", 25.0, 15.0, 120.0), ("50", 50.0, 15.0, 120.0))
MIXED_POOLS = (("20", 20.0, 15.0, 35.0), ("25", 25.0, 18.0, 45.0), ("50", 50.0, 35.0, 120.0), ("25yd", 23.0, 15.0, 40.0), ("50yd", 46.0, 35.0, 120.0))


def pool_history(swims: DataFrame, keys: list[str], pools: tuple = METRIC_POOLS) -> DataFrame:
    """``keys, swum``: how often each pool is the only one that divides the distance, as a map from its name."""
    distance = F.col("distance")
    fits = F.array_compact(F.array(*(F.when((distance > 0) & (distance % m == 0), name) for name, m, _, _ in pools)))
    counts = swims.select(*keys, fits.alias("fits")).where("size(fits) = 1").groupBy(*keys, F.col("fits")[0].alias("pool")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pool", "n"))).alias("swum"))  # as many entries as there are pools


def with_pool(swims: DataFrame, keys: list[str], pools: tuple = METRIC_POOLS) -> DataFrame:
    """Adds ``pool``: of the pools that divide the distance and are swum in a plausible time each, the one that ``keys`` swam in most often
    where only one fitted; the first of ``pools`` among equals, null where none fits or a measure is missing."""
    distance, seconds = F.col("distance"), F.col("moving_time")
    options = []
    for at, (name, m, low, high) in enumerate(pools):
        each = seconds / (distance / m)
        options.append(F.when((distance > 0) & (seconds > 0) & (distance % m == 0) & (each >= low) & (each <= high), F.struct((-F.coalesce(F.try_element_at("swum", F.lit(name)), F.lit(0))).alias("n"), F.lit(at).alias("at"), F.lit(name).alias("name"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    return swims.join(pool_history(swims, keys, pools), keys, "left").withColumn("pool", best["name"]).drop("swum")


def corrected(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distances multiplied by an athlete's factor up to a day, and tagged; ``corrections`` has athlete_id, until_day, factor, tag."""
    joined = df.join(corrections, "athlete_id", "left")
    hit = F.col("day") <= F.col("until_day")
    return joined.withColumns({"distance": F.when(hit, F.col("distance") * F.col("factor")).otherwise(F.col("distance")), "tag": F.when(hit, F.col("tag"))}).drop("until_day", "factor")


def bike_type(name: Column, sport: Column, trainer: Column) -> Column:
    return (
        F.when(sport == "MountainBikeRide", "mtb").when(sport.isin("GravelRide", "GravelBikeRide"), "gravel").when(sport == "EBikeRide", "electric")
        .when((sport == "VirtualRide") | F.coalesce(trainer, F.lit(False)), "indoor").otherwise("road")
    )


def gear_wear(summary: DataFrame, as_of: str, life_km: float, price: float) -> DataFrame:
    """Use against life: share, what remains, cost by km, whether to replace, and at the pace so far the weeks left and the day on which the life ends (null without use)."""
    km = F.col("km")
    weeks = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.col("first_use")) / 7.0, F.lit(1.0))
    left = F.greatest(F.lit(0.0), life_km - km)
    weeks_left = left / F.nullif(km / weeks, F.lit(0.0))
    return summary.withColumns({"used_pct": km / life_km * 100, "km_left": left, "cost_km": ratio(F.lit(price), km), "replace": km >= life_km, "weeks_left": weeks_left, "ends": F.date_add(F.lit(as_of).cast("date"), F.ceil(weeks_left * 7).cast("int"))})
