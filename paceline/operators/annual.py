"""The report of a year, and records of all time, for each athlete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up, hour_bucket, percent_change, ratio, week_start

#: What belongs to the categories of a report; every other sport is ``Other``.
CATEGORIES = {
    "Run": ("Run", "TrailRun", "VirtualRun"), "Ride": ("Ride", "VirtualRide", "GravelRide", "GravelBikeRide", "MountainBikeRide", "EBikeRide"), "Swim": ("Swim", "OpenWaterSwim"),
    "Gym": ("Workout", "WeightTraining", "Crossfit", "Yoga"),
}
BUCKETS = ("night", "morning", "afternoon", "evening")


def category(sport: Column) -> Column:
    out = F.lit("Other")
    for name, sports in CATEGORIES.items():
        out = F.when(sport.isin(*sports), name).otherwise(out)
    return out


def best(value: Column, held: Column | None = None) -> Column:
    """The id, day and value of the row with the largest ``value``, the smallest id among equals; null values and rows not ``held`` don't count."""
    own = value if held is None else F.when(held, value)
    return F.max_by(F.struct("id", "day", own.alias("value")), F.when(own.isNotNull(), F.struct(own, -F.col("id"))))


def streaks_to(days: DataFrame, keys: list[str], until: Column) -> DataFrame:
    """``longest_streak`` and ``current_streak`` of consecutive days in ``days`` (``keys, day``), the current one ending on ``until``, else 0."""
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    seen = days.select(*keys, "day").distinct()
    island = number - F.row_number().over(Window.partitionBy(*keys).orderBy("day"))
    runs = seen.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_streak"), F.coalesce(F.max(F.when(F.col("last") == until, F.col("n"))), F.lit(0)).alias("current_streak"))


def annual_report(df: DataFrame, keys: list[str], year: int) -> DataFrame:
    """A nested row for each of ``keys`` with activities in ``year``.

    Totals and their change in percent on the year before, active days and streaks, the best week and month by distance (the earliest among
    equals), time by category and the runs' share of it, sports by time, hours by month, weekday (from Monday) and part of the day, records, and the
    shares of activities alone and with others among those that tell. ``df`` has ``keys, id, day, start_ts, sport_type, distance, moving_time,
    total_elevation_gain, athlete_count``; nulls count as zero in sums. Lists have at most 12 entries, or as many as there are sports.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rows = df.where(F.year("day").isin(year, year - 1)).withColumns({"_now": F.year("day") == year, "_hours": zero("moving_time") / 3600, "_category": category(F.col("sport_type")), "_pace": F.when((F.col("distance") >= 3000) & (F.col("moving_time") > 0), F.col("moving_time") / (F.col("distance") / 1000))})
    now = rows.where("_now")
    totals = {"distance": zero("distance"), "seconds": zero("moving_time"), "elevation": zero("total_elevation_gain")}
    both = rows.groupBy(*keys).agg(F.count_if("_now").alias("n"), *(F.sum(F.when(F.col("_now"), v)).alias(k) for k, v in totals.items()), *(F.sum(F.when(~F.col("_now"), v)).alias(f"_{k}") for k, v in totals.items()), F.countDistinct(F.when(F.col("_now"), F.col("day"))).alias("active_days")).where("n > 0")
    both = both.withColumns({f"{k}_change": percent_change(F.col(k), F.coalesce(f"_{k}", F.lit(0.0))) for k in totals}).drop(*(f"_{k}" for k in totals))
    hours = lambda held: F.sum(F.when(held, F.col("_hours")).otherwise(0.0))
    names = [*CATEGORIES, "Other"]
    alone, told = F.count_if(F.col("athlete_count") == 1), F.count("athlete_count")
    is_ = lambda c: F.col("_category") == c
    parts = now.groupBy(*keys).agg(
        F.struct(*(hours(is_(c)).alias(c.lower()) for c in names)).alias("category_hours"), (hours(is_("Run")) * 100 / F.nullif(F.sum("_hours"), F.lit(0.0))).alias("run_share"), F.array(*(hours(F.month("day") == m) for m in range(1, 13))).alias("month_hours"),
        F.array(*(hours(F.weekday("day") == d) for d in range(7))).alias("weekday_hours"), F.struct(*(hours(hour_bucket(F.hour("start_ts")) == b).alias(b) for b in BUCKETS)).alias("part_hours"),
        best(F.col("distance")).alias("longest"), best(F.col("total_elevation_gain")).alias("most_elevation"), best(-F.col("_pace"), is_("Run")).alias("fastest_run"), best(F.col("distance"), is_("Run")).alias("longest_run"), best(F.col("distance"), is_("Ride")).alias("longest_ride"),
        best(F.col("distance"), is_("Swim")).alias("longest_swim"), (alone * 100.0 / F.nullif(told, F.lit(0))).alias("solo_share"),
    )
    parts = parts.withColumn("fastest_run", F.struct(F.col("fastest_run.id"), F.col("fastest_run.day"), (-F.col("fastest_run.value")).alias("value")))
    out = both.join(parts, keys).join(streaks_to(now, keys, F.lit(f"{year}-12-31").cast("date")), keys)
    for name, start in (("week", week_start(F.col("day"))), ("month", F.trunc("day", "month"))):
        per = now.groupBy(*keys, start.alias("start")).agg((F.sum(zero("distance")) / 1000).alias("km"), F.sum("_hours").alias("hours"))
        out = out.join(per.groupBy(*keys).agg(F.max_by(F.struct("start", "km", "hours"), F.struct(half_up(F.col("km"), 6), -F.unix_date("start"))).alias(f"top_{name}")), keys)
    sports = now.groupBy(*keys, "sport_type").agg(F.sum("_hours").alias("hours"), F.sum(zero("distance")).alias("distance"), F.sum(zero("total_elevation_gain")).alias("elevation"), F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-half_up(F.col("hours"), 6)).alias("k"), "sport_type", "hours", "distance", "elevation", "n"))), lambda s: s.dropFields("k"))
    return out.join(sports.groupBy(*keys).agg(listed.alias("sports")), keys)


def record_stats(df: DataFrame, keys: list[str], hour_shift: int = 0) -> DataFrame:
    """Records and habits of all time: the longest activity, the fastest of more than a kilometre (of any length if there is none), the one with most climb,
    the days from first to last, the favourite hour (moved by ``hour_shift``) and weekday (from Monday, 0), the smallest among equals, mean
    distance and pace (0 without a speed, as all count), and the shares alone and with others. Columns as for ``annual_report``."""
    speed = ratio(F.col("distance"), F.col("moving_time").cast("double"))
    hour = F.pmod(F.hour("start_ts") + hour_shift, F.lit(24))
    counts = lambda of, values: F.array(*(F.count_if(of == v) for v in values))
    s = df.withColumn("_speed", F.when(speed > 0, speed))
    out = s.groupBy(*keys).agg(
        F.count("*").alias("n"), best(F.col("distance")).alias("longest"), best(F.col("_speed"), F.col("distance") > 1000).alias("_fast"), best(F.col("_speed")).alias("_any"), best(F.col("total_elevation_gain")).alias("most_elevation"),
        F.floor((F.unix_micros(F.max("start_ts").cast("timestamp")) - F.unix_micros(F.min("start_ts").cast("timestamp"))) / 86_400_000_000).alias("span_days"), counts(hour, range(24)).alias("_hours"), counts(F.weekday("day"), range(7)).alias("_days"),
        (F.sum(F.coalesce("distance", F.lit(0.0))) / F.count("*") / 1000).alias("mean_km"), (F.sum(F.coalesce(1000 / F.col("_speed") / 60, F.lit(0.0))) / F.count("*")).alias("mean_pace"), (F.count_if(F.col("athlete_count") == 1) * 100.0 / F.count("*")).alias("solo_share"),
    )
    first = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int")
    return out.withColumns({"fastest": F.coalesce("_fast", "_any"), "favourite_hour": first(F.col("_hours")), "favourite_weekday": first(F.col("_days")), "group_share": 100 - F.col("solo_share")}).drop("_fast", "_any", "_hours", "_days")
