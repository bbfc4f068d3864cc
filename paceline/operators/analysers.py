"""Analyses of whole tracks: physics, segments, stretches and physiology, one shuffle by activity each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import ratio
from paceline.operators.points import deltas, track
from paceline.operators.windows import islands


def estimated_power(speed: Column, grade: Column, mass: float = 75.0, cda: float = 0.35, crr: float = 0.004, density: float = 1.225) -> Column:
    """Watts from speed (km/h) and grade (percent): gravity, rolling and air, never negative, zero while standing."""
    v = speed / 3.6
    watts = mass * 9.81 * (grade / 100) * v + mass * 9.81 * crr * v + 0.5 * density * cda * v * v * v
    return F.when(speed > 0, F.greatest(F.lit(0.0), watts)).otherwise(0.0)


def wind_component(bearing: Column, direction: float, speed: float) -> Column:
    gap = F.abs(bearing - direction)
    return speed * F.cos(F.radians(F.when(gap > 180, 360 - gap).otherwise(gap)))


def drag_power(speed: Column, headwind: Column, cda: float = 0.3, density: float = 1.225) -> Column:
    v = speed / 3.6
    air = v + headwind / 3.6
    return F.greatest(F.lit(0.0), 0.5 * density * cda * air * air * v)


def wind_adjusted_pace(speed: Column, component: Column) -> Column:
    return 60 / F.greatest(F.lit(0.1), speed + component / 10)


def grade_adjusted_pace(speed: Column, grade: Column) -> Column:
    """Minutes a kilometre on the flat."""
    return 60 / (speed / F.exp(grade / 100 * 0.05))


def stream_climbs(points: DataFrame, min_km: float = 0.3, min_gain: float = 20.0, min_grade: float = 3.0, min_step: float = 5.0) -> DataFrame:
    """Runs of rising steps. Steps shorter than ``min_step`` metres are passed over; a climb still open at the end is lost."""
    steps = points.withColumn("climb", F.col("elevation") - F.lag("elevation").over(track())).where((F.col("idx") > 0) & (F.col("step_m") >= min_step))
    last = F.max("idx").over(Window.partitionBy("activity_id"))
    rising = (F.col("climb") / F.col("step_m") * 100 >= min_grade) & (F.col("climb") > 0)
    runs = islands(steps.withColumn("last", last), rising, ["activity_id"], "idx").groupBy("activity_id", "island").agg(
        (F.min("idx") - 1).alias("start_idx"), F.max("idx").alias("end_idx"), F.sum("climb").alias("gain"), F.sum("step_m").alias("metres"), F.max("last").alias("last"),
    )
    kept = runs.where((F.col("end_idx") < F.col("last")) & (F.col("metres") / 1000 >= min_km) & (F.col("gain") >= min_gain) & (F.col("gain") / F.col("metres") * 100 >= min_grade))
    return kept.select("activity_id", "start_idx", "end_idx", "gain", "metres", (F.col("gain") / F.col("metres") * 100).alias("grade"))


def terrain_segments(points: DataFrame, terrain: Column, jump_km: float = 0.1) -> DataFrame:
    """Stretches of one terrain; a change of class or a jump in distance opens the next."""
    own = deltas(points).withColumn("terrain", terrain)
    new = (F.col("terrain") != F.lag("terrain").over(track())) | (F.col("km") - F.lag("km").over(track()) > jump_km)
    numbered = own.withColumn("segment", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(track().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("activity_id", "segment").agg(
        F.first("terrain").alias("terrain"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), (F.max("km") - F.min("km")).alias("km"),
        F.sum(F.greatest("climb", F.lit(0.0))).alias("gain"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"), F.count("*").alias("n"),
    )


def best_stretch(points: DataFrame, length_km: float = 1.0, step_km: float = 0.1) -> DataFrame:
    """The fastest and slowest stretch of a length, starts on a grid. Each sample goes to the few stretches it lies in, so no
    grid is joined with the samples."""
    own = deltas(points).withColumn("total", F.max("km").over(Window.partitionBy("activity_id")))
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("km") - length_km) / step_km) - 1).cast("int"), (F.floor(F.col("km") / step_km) + 1).cast("int")))
    inside = own.select("activity_id", "idx", "km", "total", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), k.alias("k")).where(
        (F.col("km") >= F.col("k") * step_km) & (F.col("km") <= F.col("k") * step_km + length_km) & (F.col("k") * step_km < F.col("total") - length_km)
    )
    s = inside.groupBy("activity_id", "k").agg(F.min("km").alias("a"), F.max("km").alias("b"), F.min("t").alias("t0"), F.max("t").alias("t1")).where("t1 > t0 and b > a")
    s = s.withColumn("speed", (F.col("b") - F.col("a")) / ((F.col("t1") - F.col("t0")) / 3.6e9))
    return s.groupBy("activity_id").agg(
        F.min_by("k", F.struct(-F.col("speed"), F.col("k"))).alias("fastest_k"), F.max("speed").alias("fastest"), F.min_by("k", F.struct("speed", "k")).alias("slowest_k"), F.min("speed").alias("slowest"),
    )


def pace_halves(points: DataFrame) -> DataFrame:
    """Mean pace of the moving samples, and of each half of all samples; the split is positive if the second half is slower."""
    n = F.count("*").over(Window.partitionBy("activity_id"))
    pace = F.when(F.col("speed") > 0, 60 / F.col("speed"))
    at = points.withColumns({"pace": pace, "late": F.col("idx") >= F.floor(n / 2)})
    half = lambda late: F.sum(F.when(F.col("late") == late, F.col("pace"))) / F.nullif(F.count(F.when(F.col("late") == late, 1)), F.lit(0))
    sums = at.groupBy("activity_id").agg(F.avg(F.when(F.col("moving"), F.col("pace"))).alias("pace"), half(False).alias("first_half"), half(True).alias("second_half"))
    return sums.withColumn("positive_split", F.col("second_half") > F.col("first_half"))


def steadiness(points: DataFrame, value: str) -> DataFrame:
    """Mean, largest and share of positive values within the quartiles, which are values by rank."""
    some = points.where(F.col(value) > 0)
    w = Window.partitionBy("activity_id")
    ranked = some.withColumns({"_r": F.row_number().over(w.orderBy(value, "idx")) - 1, "_n": F.count("*").over(w)})
    quartile = lambda q: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * q), F.col(value))).over(w)
    at = ranked.withColumns({"_q1": quartile(0.25), "_q3": quartile(0.75)})
    share = F.count(F.when((F.col(value) >= F.col("_q1")) & (F.col(value) <= F.col("_q3")), 1)) * 100.0 / F.count("*")
    out = at.groupBy("activity_id").agg(F.floor(F.avg(value) + 0.5).alias("mean"), F.max(value).alias("most"), share.alias("share"), F.count("*").alias("n")).where("n >= 2").drop("n")
    return out.withColumn("consistency", F.when(F.col("share") > 80, "high").when(F.col("share") > 60, "moderate").otherwise("low"))


def physiology(points: DataFrame, threshold: float = 160.0) -> DataFrame:
    """Heart rate and power blocks: means, extremes, spread, share of samples at or above a threshold, power a beat."""
    hr, power = F.when(F.col("heart_rate") > 0, F.col("heart_rate")), F.when(F.col("power") > 0, F.col("power"))
    out = points.groupBy("activity_id").agg(
        F.avg(hr).alias("hr"), F.max(hr).alias("hr_max"), F.min(hr).alias("hr_min"), F.stddev_pop(hr).alias("hr_sd"), (F.count(F.when(hr >= threshold, 1)) * 100.0 / F.nullif(F.count(hr), F.lit(0))).alias("above_pct"),
        F.avg(power).alias("watts"), F.max(power).alias("watts_max"),
    )
    return out.withColumn("watts_a_beat", ratio(F.col("watts"), F.col("hr")))


def scaled(value: Column, keys: list[str], flat: float = 0.5) -> Column:
    """Place of a value between the least and the greatest of its group; ``flat`` where they are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(flat)


def laps_table(laps: DataFrame) -> DataFrame:
    """Laps with their pace (seconds a kilometre), strokes a metre where strokes are given, and how the activity's laps vary
    (sample deviation over mean)."""
    w = Window.partitionBy("activity_id")
    pace = ratio(F.col("seconds").cast("double"), F.col("km"))
    at = laps.withColumn("pace", pace)
    return at.withColumns({"pace_cv": ratio(F.stddev_samp("pace").over(w), F.avg("pace").over(w)), "hr_cv": ratio(F.stddev_samp("heart_rate").over(w), F.avg("heart_rate").over(w)), "strokes_m": ratio(F.col("strokes").cast("double"), F.col("km") * 1000)})


def efforts_table(efforts: DataFrame) -> DataFrame:
    """Efforts over segments or standard distances with their pace (minutes a km) and what they achieved: a personal record or its place,
    else the place among all. ``efforts`` has ``distance`` (metres), ``moving_time``, ``pr_rank`` and ``kom_rank``; null or zero ranks are none."""
    place = F.when(F.col("pr_rank") == 1, "PR!").when(F.col("pr_rank") > 1, F.concat(F.lit("PR #"), F.col("pr_rank").cast("string"))).when(F.col("kom_rank") == 1, "KOM/QOM!").when(F.col("kom_rank") > 1, F.concat(F.lit("Top "), F.col("kom_rank").cast("string")))
    return efforts.withColumns({"pace": ratio(F.col("moving_time") / 60.0, F.col("distance") / 1000.0), "rank": F.coalesce(place, F.lit(""))})
