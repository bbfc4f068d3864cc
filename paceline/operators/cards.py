"""Summary cards, labels and small reports over activities and equipment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import half_up, ratio
from paceline.operators.aggregates import period_start, spine


def max_heart_rate(profile: Column, zones_last: Column, default: float = 190.0) -> Column:
    """The profile's, else the last zone's upper end where it is closed, else a default."""
    return F.coalesce(F.nullif(profile, F.lit(0.0)), F.when(zones_last > 0, zones_last), F.lit(default))


def vo2_at_pace(distance: Column, seconds: Column, heart_rate: Column, most: float = 195.0) -> Column:
    """Oxygen uptake at the pace over the share of the maximal heart rate; null for missing measures and odd shares."""
    share = heart_rate / most
    there = (F.coalesce(distance, F.lit(0)) != 0) & (F.coalesce(seconds, F.lit(0)) != 0) & (F.coalesce(heart_rate, F.lit(0)) != 0)
    return F.when(there & share.between(0.5, 1.2), (distance / seconds * 60 * 0.2 + 3.5) / share)


def swim_type(sport: Column, trainer: Column, has_start: Column) -> Column:
    indoor = sport.rlike("(?i)swim") & ~sport.rlike("(?i)openwater") & (F.coalesce(trainer, F.lit(False)) | ~F.coalesce(has_start, F.lit(False)))
    return F.when(indoor, "pool").otherwise("openwater")


def swims(df: DataFrame) -> DataFrame:
    """Distance in km, pace for 100 m in seconds and minutes, kind, and moving share (1 if the elapsed time is missing)."""
    pace = F.when((F.col("distance") > 0) & (F.col("moving_time") > 0), F.col("moving_time") / (F.col("distance") / 100))
    moving = F.when(F.coalesce("elapsed_time", F.lit(0)) != 0, F.coalesce("moving_time", F.lit(0)) / F.col("elapsed_time")).otherwise(1.0)
    return df.withColumns({"distance_km": F.coalesce("distance", F.lit(0.0)) / 1000, "pace_sec100": pace, "pace_min100": pace / 60, "swim_type": swim_type(F.col("sport_type"), F.col("trainer"), F.col("has_start")), "moving_ratio": moving})


def group_bucket(people: Column) -> Column:
    n = F.coalesce(F.nullif(people, F.lit(0)), F.lit(1))
    return F.when(n == 1, "solo").when(n == 2, "duo").when(n.between(3, 15), "small").otherwise("large")


def shifted_hour(ts: Column, shift: int = 0) -> Column:
    """Hour of the day, moved back by ``shift``."""
    return F.pmod(F.hour(ts) - shift, F.lit(24))


def shoe_type(trail_share: Column) -> Column:
    return F.when(trail_share > 0.3, "trail").otherwise("road")


def gear_kind(frame_type: Column, weight: Column) -> Column:
    return F.when(frame_type.isNotNull() | weight.isNotNull(), "bike").otherwise("shoe")


def favourite(uses: DataFrame, by: Column, name: str) -> DataFrame:
    """Each piece's most frequent value of ``by``, the smallest among equals."""
    counts = uses.groupBy("gear_id", by.alias("v")).agg(F.count("*").alias("n"))
    return counts.groupBy("gear_id").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(name))


def atl_label(delta: Column) -> Column:
    return F.when(delta >= 22, "Strained").when(delta >= 12, "Overload").when(delta >= 4, "Build").when(delta > -6, "Productive").otherwise("Recovery")


def ctl_label(rank: Column) -> Column:
    return F.when(rank >= 0.9, "Peak fitness").when(rank >= 0.7, "High fitness").when(rank >= 0.45, "Productive").when(rank >= 0.25, "Maintaining").otherwise("Rebuilding")


def tsb_label(tsb: Column, deep: float, fatigue: float, balanced: float, fresh: float) -> Column:
    return (
        F.when(tsb <= deep, "Strained").when(tsb <= fatigue, "Heavy load").when(tsb <= balanced, "Productive").when(tsb <= fresh, "Race-ready")
        .when(tsb <= fresh + 8, "Recovery").otherwise("Underload")
    )


def readiness_label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Very Good").when(score >= 60, "Good").when(score >= 40, "Fair").otherwise("Poor")


def load_band(ctl: Column, aggressive: bool = False) -> tuple[Column, Column]:
    """Lower and upper end of the productive weekly load, kept apart by a least width, to one decimal."""
    low, high, width = (0.75, 1.30, 30.0) if aggressive else (0.85, 1.10, 20.0)
    base = F.greatest(F.lit(10.0), ctl * 7)
    a, b = base * low, base * high
    narrow = b - a < width
    mid = (a + b) / 2
    return half_up(F.greatest(F.lit(0.0), F.when(narrow, mid - width / 2).otherwise(a)), 1), half_up(F.when(narrow, mid + width / 2).otherwise(b), 1)


def band_label(load: Column, lower: Column, upper: Column) -> Column:
    slack = F.greatest(F.lit(8.0), (upper - lower) * 0.08)
    return F.when(load < lower - slack, "Below range").when(load > upper + slack, "Above range").otherwise("In range")


def stacked(df: DataFrame, period: str, sports: list[str], value: Column, keys: list[str]) -> DataFrame:
    """Sums by period, a column a sport, periods without rows as zero."""
    wide = df.groupBy(*keys, period_start(F.col("day"), period).alias("period")).pivot("sport_type", sports).agg(F.sum(value))
    return spine(df, period, keys).join(wide, [*keys, "period"], "left").fillna(0, subset=sports)


def week_from_sunday(day: Column) -> Column:
    """The Monday of a week in which Sunday belongs to the Monday after it."""
    return F.date_add(day, 2 - F.dayofweek(day))


def last_closed_zone(zones: DataFrame) -> DataFrame:
    """Each athlete's zones of a positive upper end, as shares of the whole width, and the lower end of zone 4 (else the last)."""
    w = Window.partitionBy("athlete_id")
    some = zones.where(F.col("max") > 0)
    total = F.max_by("max", "zone").over(w) - F.min_by("min", "zone").over(w)
    fourth = F.coalesce(F.max(F.when(F.col("zone") == 4, F.col("min"))).over(w), F.max_by("min", "zone").over(w))
    return some.withColumns({"share": ratio((F.col("max") - F.col("min")) * 100, total), "ftp": fourth})


def gear_profile(uses: DataFrame) -> DataFrame:
    """All of a piece's use: totals, means, span, favourite weekday (from Monday, 0) and hour, bests, speeds in km/h and how many activities have a heart rate.

    ``uses`` has a row for each activity: ``gear_id, day, start_ts, distance, moving_time, average_heartrate``. Sums of distance are exact, so they don't depend on the order of rows.
    """
    km, hr = F.col("distance") / 1000, F.when(F.col("average_heartrate") > 0, F.col("average_heartrate"))
    paced = F.when((F.col("distance") > 0) & (F.col("moving_time") > 0), F.col("moving_time") / km)
    sums = uses.groupBy("gear_id").agg(
        F.count("*").alias("n"), F.sum(km.cast("decimal(18,6)")).cast("double").alias("km"), (F.sum("moving_time") / 3600.0).alias("hours"), F.min("day").alias("_a"), F.max("day").alias("_b"), F.max(km).alias("longest_km"), F.min(paced).alias("best_pace"),
        (F.max(F.col("distance") / F.nullif(F.col("moving_time"), F.lit(0))) * 3.6).alias("top_speed"), (F.count(hr) * 100.0 / F.count("*")).alias("hr_cover"), F.avg(hr).alias("hr"), F.max(hr).alias("hr_max"),
    )
    span = F.greatest(F.lit(1), F.datediff("_b", "_a"))
    own = sums.withColumns({"mean_km": F.col("km") / F.col("n"), "span_days": span.cast("long"), "km_week": F.col("km") / F.greatest(F.lit(1.0), span / 7.0), "speed": F.col("km") / F.nullif(F.col("hours"), F.lit(0.0))}).drop("_a", "_b")
    return own.join(favourite(uses, F.weekday("day"), "weekday"), "gear_id").join(favourite(uses, F.hour("start_ts"), "hour"), "gear_id")
