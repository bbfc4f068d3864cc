"""Sample-level operators, for all activities at once: partitioned by activity_id and ordered by idx."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import exact_mean, half_up
from paceline.operators.windows import islands


def track():
    """An activity's samples in order."""
    return Window.partitionBy("activity_id").orderBy("idx")


def so_far():
    return track().rowsBetween(Window.unboundedPreceding, 0)


def from_streams(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel arrays, a row per activity, as a row per sample; shorter arrays are filled up with nulls."""
    return streams.select("activity_id", F.posexplode(F.arrays_zip(*keys)).alias("idx", "p")).select("activity_id", "idx", *[F.col(f"p.{k}").alias(k) for k in keys])


def deltas(points: DataFrame) -> DataFrame:
    """Steps from the point before: seconds, metres of climb, acceleration, distance from the start and cumulated gain and loss."""
    climb = F.coalesce(F.col("elevation") - F.lag("elevation").over(track()), F.lit(0.0))
    seconds = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(track())), F.lit(0))
    at = points.withColumns({"d_time": seconds, "climb": climb, "d_speed": F.coalesce(F.col("speed") - F.lag("speed").over(track()), F.lit(0.0))})
    return at.withColumns({
        "km": F.sum("step_m").over(so_far()) / 1000.0, "gain": F.sum(F.greatest("climb", F.lit(0.0))).over(so_far()), "loss": F.sum(F.greatest(-F.col("climb"), F.lit(0.0))).over(so_far()),
        "acceleration": F.col("d_speed") / F.nullif(F.col("d_time"), F.lit(0)),
    })


def terrain(grade: Column) -> Column:
    return F.when(F.abs(grade) > 8, "technical").when(grade > 2, "climb").when(grade < -2, "descent").otherwise("flat")


def climbs(points: DataFrame, min_grade: float = 3.0, min_km: float = 0.3, min_gain: float = 20.0, merge_km: float = 0.05) -> DataFrame:
    """Maximal runs of moving points at or above a grade; those long and high enough, near neighbours merged.

    The climb into a run's first point counts. Distances are kilometres.
    """
    own = deltas(points)
    inside = islands(own, (F.col("grade") >= min_grade) & F.col("moving"), ["activity_id"], "idx")
    raw = inside.groupBy("activity_id", "island").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("km").alias("start_km"), F.max("km").alias("end_km"), F.sum(F.greatest("climb", F.lit(0.0))).alias("gain"),
        F.max("grade").alias("max_grade"), F.avg(F.when(F.col("heart_rate") > 0, F.col("heart_rate"))).alias("avg_hr"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"),
    )
    length = F.col("end_km") - F.col("start_km")
    valid = raw.withColumn("km", length).where((length >= min_km) & (F.col("gain") >= min_gain) & (F.col("gain") / (length * 1000) * 100 >= min_grade))
    w = Window.partitionBy("activity_id").orderBy("start_idx")
    far = F.when(F.col("start_km") - F.lag("end_km").over(w) <= merge_km, 0).otherwise(1)
    merged = valid.withColumn("_far", far).withColumn("climb", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.groupBy("activity_id", "climb").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.sum("km").alias("km"), F.sum("gain").alias("gain"), F.sum("seconds").alias("seconds"), F.max("max_grade").alias("max_grade"),
    )


def climb_category(km: Column, grade: Column) -> Column:
    """By length times steepness."""
    score = km * 1000 * grade
    return F.when(score >= 80000, "HC").when(score >= 64000, "1").when(score >= 32000, "2").when(score >= 16000, "3").when(score >= 8000, "4")


def stops(points: DataFrame, below: float = 0.5, at_least: int = 5) -> DataFrame:
    """Runs of points that stand still, with their seconds; shorter ones go."""
    own = deltas(points)
    return islands(own, (F.col("speed") < below) & ~F.col("moving"), ["activity_id"], "idx").groupBy("activity_id", "island").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.sum("d_time").alias("seconds"),
    ).where(F.col("seconds") >= at_least).drop("island")


def splits(points: DataFrame, km: float = 1.0, at_least: int = 2) -> DataFrame:
    """Splits by distance, inclusive at both ends: a point on a border belongs to both splits."""
    own = deltas(points)
    metres = half_up(F.col("km") * 1000, 3)  # to the millimetre, so that borders are met exactly
    k = F.floor(metres / (km * 1000))
    both = F.when((metres == k * (km * 1000)) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    return own.withColumn("split", F.explode(both)).groupBy("activity_id", "split").agg(
        F.count("*").alias("n"), (F.max("km") - F.min("km")).alias("km"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"),
        exact_mean(F.col("speed")).alias("avg_speed"), exact_mean(F.col("heart_rate")).alias("avg_hr"), F.sum(F.greatest("climb", F.lit(0.0))).alias("gain"),
    ).where(F.col("n") >= at_least)


def segments(points: DataFrame, by: str = "distance", size: float = 1.0, at_least: int = 2) -> DataFrame:
    """Segments of ``size`` kilometres or, ``by`` time, minutes, inclusive at both ends: a sample on a border belongs to both. With all measures: distance,
    seconds, gain and loss between the first and the last sample, means of what is there, maxima, and metres an hour where it climbs."""
    own = deltas(points)
    if by == "distance":
        at, width, name = half_up(F.col("km") * 1000, 3), size * 1000, "km"  # to the millimetre, so that borders are met exactly
    else:
        at, width, name = (F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(so_far()))).cast("double"), size * 60, "min"
    own = own.withColumn("_at", at)
    end = F.max("_at").over(Window.partitionBy("activity_id"))
    k = F.floor(F.col("_at") / width)
    both = F.when((F.col("_at") == k * width) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    inside = own.withColumn("_end", end).withColumn("segment", F.explode(both)).where(F.col("segment") * width < F.col("_end"))
    first, last = (lambda c: F.min_by(c, "idx")), (lambda c: F.max_by(c, "idx"))
    mean = lambda c: F.coalesce(exact_mean(F.when(F.col(c) != 0, F.col(c))), F.lit(0.0))
    told = inside.groupBy("activity_id", "segment").agg(
        F.count("*").alias("n"), F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), (last("km") - first("km")).alias("km"), (F.unix_timestamp(last("ts")) - F.unix_timestamp(first("ts"))).alias("seconds"), (last("gain") - first("gain")).alias("gain"), (last("loss") - first("loss")).alias("loss"),
        F.min("elevation").alias("lowest"), F.max("elevation").alias("highest"), F.coalesce(exact_mean(F.col("speed")), F.lit(0.0)).alias("avg_speed"), F.max("speed").alias("max_speed"), mean("heart_rate").alias("avg_hr"), F.coalesce(F.max("heart_rate"), F.lit(0.0)).alias("max_hr"), mean("power").alias("avg_power"),
        F.coalesce(F.max("power"), F.lit(0.0)).alias("max_power"), mean("cadence").alias("avg_cadence"), F.coalesce(exact_mean(F.col("grade")), F.lit(0.0)).alias("avg_grade"), F.max("grade").alias("max_grade"), first(terrain(F.col("grade"))).alias("terrain"),
    ).where(F.col("n") >= at_least)
    label = lambda x: F.format_string("%.1f", x) if by == "distance" else F.floor(x).cast("string")
    start = F.col("segment") * float(size)
    return told.withColumns({"name": F.concat(label(start), F.lit("-"), label(start + float(size)), F.lit(f" {name}")), "vam": F.when((F.col("gain") > 0) & (F.col("seconds") > 0), F.col("gain") / (F.col("seconds") / 3600))})


#: The upper ends of the heart-rate zones in percent of the maximum, and of the power zones in percent of the threshold.
HEART_RATE_ENDS, POWER_ENDS = (60, 70, 80, 90), (55, 75, 90, 105, 120)


def zone_percents(points: DataFrame, max_hr: float = 195.0, ftp: float = 250.0) -> DataFrame:
    """Per activity the whole percent of samples with a heart rate in each of five zones (``hr_1`` ...) and of those with a power in each of six (``power_1`` ...); zero in all without any."""
    told = []
    for name, column, whole, ends in (("hr", "heart_rate", max_hr, HEART_RATE_ENDS), ("power", "power", ftp, POWER_ENDS)):
        share, n = positive(column) / whole * 100, F.count(positive(column))
        for k in range(len(ends) + 1):
            inside = (F.lit(True) if k == 0 else share >= ends[k - 1]) & (share.isNotNull() if k == len(ends) else share < ends[k])
            told.append(F.coalesce(half_up(F.count_if(inside) / F.nullif(n, F.lit(0)) * 100), F.lit(0.0)).cast("int").alias(f"{name}_{k + 1}"))
    return points.groupBy("activity_id").agg(*told)


def pace_stream(points: DataFrame, window: int = 1) -> DataFrame:
    """Adds ``pace`` in minutes a km from the step before (null without distance or time), ``pace_smooth``, its mean over the last ``window``
    samples, and ``steps_a_minute``, the cadence of both feet on runs (null for zero)."""
    moved = (F.col("step_m") > 0) & (F.col("d_time") > 0) & (F.col("idx") > 0)
    own = deltas(points).withColumn("pace", F.when(moved, 1000 / (F.col("step_m") / F.col("d_time")) / 60))
    feet = F.when(F.col("sport_type").isin("Run"), F.nullif(F.col("cadence"), F.lit(0.0)) * 2).otherwise(F.col("cadence"))
    return own.withColumns({"pace_smooth": F.avg("pace").over(track().rowsBetween(1 - window, 0)), "steps_a_minute": feet})


def variability(points: DataFrame, value: str, window: int = 1, skip_missing: bool = False) -> DataFrame:
    """Per activity the coefficient of variation, in percent, of ``value`` smoothed over the last ``window`` samples (or, with ``skip_missing``, the last
    so many that have a value): sample deviation over mean of what is above zero; null below two such values."""
    rows = points.where(F.col(value).isNotNull()) if skip_missing else points
    smooth = rows.withColumn("_s", F.avg(value).over(track().rowsBetween(1 - window, 0))).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")))
    return smooth.groupBy("activity_id").agg((F.stddev_samp("_s") / F.avg("_s") * 100).alias("cv"))


#: Lengths of the power curve, in samples.
DURATIONS = (1, 5, 10, 30, 60, 120, 300, 600, 1200, 1800, 3600)


def positive(name: str) -> Column:
    """A measure where it is above zero; zero means that nothing was measured."""
    return F.when(F.col(name) > 0, F.col(name))


def power_curve(points: DataFrame, durations: tuple[int, ...] = DURATIONS) -> DataFrame:
    """Best mean power over each number of samples, from one running sum per activity; null where the track is shorter, a missing
    sample counts as zero. ``ftp`` is 95 percent of the best twenty minutes, both to whole watts."""
    total = F.sum(F.coalesce("power", F.lit(0.0))).over(so_far())
    s = points.select("activity_id", "idx", F.row_number().over(track()).alias("k"), total.alias("s"))
    best = lambda d: F.greatest(F.lit(0.0), F.max(F.when(F.col("k") >= d, (F.col("s") - F.coalesce(F.col(f"_l{d}"), F.lit(0.0))) / d)))
    means = [F.when(F.count("*") >= d, best(d)).alias(f"best_{d}") for d in durations]
    out = s.withColumns({f"_l{d}": F.lag("s", d).over(track()) for d in durations}).groupBy("activity_id").agg(*means)
    return out.withColumn("ftp", half_up(half_up(F.col("best_1200")) * 0.95).cast("int")) if 1200 in durations else out


def normalised_power(points: DataFrame, samples: int = 30) -> DataFrame:
    """Fourth root of the mean fourth power of full trailing windows of the samples that have a power, zero included, to whole watts;
    null below one window. ``p4_mean`` is the fourth root of the mean fourth power of all positive samples, their mean below one window."""
    valid = F.coalesce(F.col("power") >= 0, F.lit(False))
    own = Window.partitionBy("activity_id", "_valid").orderBy("idx")
    at = points.withColumn("_valid", valid).withColumns({"_k": F.row_number().over(own), "_mean": F.avg("power").over(own.rowsBetween(-(samples - 1), 0))})
    full = F.when(F.col("_valid") & (F.col("_k") >= samples), F.pow("_mean", F.lit(4.0)))
    watts = positive("power")
    whole = F.when(F.count(watts) < samples, F.avg(watts)).otherwise(F.pow(F.avg(F.pow(watts, F.lit(4.0))), F.lit(0.25)))
    return at.groupBy("activity_id").agg(half_up(F.pow(F.avg(full), F.lit(0.25))).cast("int").alias("np"), whole.alias("p4_mean"))


def normalised_power_ahead(points: DataFrame, samples: int = 30) -> DataFrame:
    """The same from windows of the samples ahead, powers above zero alone counting, for each sample with more than ``samples`` from it on;
    the mean of all powers above zero where there is no window."""
    at = points.withColumns({"_n": F.count("*").over(Window.partitionBy("activity_id")), "_k": F.row_number().over(track()), "_mean": F.avg(positive("power")).over(track().rowsBetween(0, samples - 1))})
    full = F.when(F.col("_k") <= F.col("_n") - samples, F.pow("_mean", F.lit(4.0)))
    return at.groupBy("activity_id").agg(F.coalesce(F.pow(F.avg(full), F.lit(0.25)), F.avg(positive("power"))).alias("np"))


def drift(points: DataFrame) -> DataFrame:
    """Heart rate of the last quarter of the samples against the first, in percent."""
    n = F.count("*").over(Window.partitionBy("activity_id"))
    at = points.withColumn("_n", n)
    first = F.avg(F.when(F.col("idx") < F.floor(F.col("_n") / 4), F.col("heart_rate")))
    last = F.avg(F.when(F.col("idx") >= F.col("_n") - F.floor(F.col("_n") / 4), F.col("heart_rate")))
    return at.groupBy("activity_id").agg(first.alias("first_hr"), last.alias("last_hr")).withColumn("drift_pct", (F.col("last_hr") - F.col("first_hr")) / F.nullif(F.col("first_hr"), F.lit(0.0)) * 100)


#: The change against the window before that counts as a sign of fatigue. Pace and heart rate rise, cadence and power fall.
SIGNS = {"pace": 0.1, "hr": 0.05, "cadence": 0.08, "power": 0.08}


def prefix_sums(points: DataFrame) -> DataFrame:
    """Adds ``sums``: for pace (of moving samples), heart rate, cadence and power the sum and the number of positive values so far."""
    values = {"pace": F.when(F.col("moving") & (F.col("speed") > 0), 60 / F.col("speed")), "hr": positive("heart_rate"), "cadence": positive("cadence"), "power": positive("power")}
    return points.withColumn("sums", F.struct(*(x for k, v in values.items() for x in (F.coalesce(F.sum(v).over(so_far()), F.lit(0.0)).alias(k), F.count(v).over(so_far()).alias(f"{k}_n")))))


def fatigue_windows(prefix: Column) -> Column:
    """For each sample from the window's length on: the signs of fatigue and their severity, as an array.

    The window is a tenth of the activity's own samples; the samples before each one are held against those from it on.
    ``prefix`` is the activity's array of (idx, sums, km, second), so every mean is a difference of two places in it.
    """
    n = F.size(prefix)
    width = F.floor(n * 0.1).cast("int")
    sums = lambda j: F.get(prefix, j)["sums"]

    def mean(k: str, low: Column, high: Column) -> Column:
        """Of the samples after place ``low`` up to ``high``."""
        start = lambda c: F.coalesce(F.when(low >= 0, sums(low)[c]), F.lit(0))
        return F.nullif((sums(high)[k] - start(k)) / F.nullif(sums(high)[f"{k}_n"] - start(f"{k}_n"), F.lit(0)), F.lit(0.0))

    def one(i: Column) -> Column:
        last = F.least(i + width, n) - 1
        signs = []
        for k, limit in SIGNS.items():
            a, b = mean(k, i - width - 1, i - 1), mean(k, i - 1, last)
            change = (b - a) / a if k in ("pace", "hr") else (a - b) / a
            signs.append(F.coalesce(change > limit, F.lit(False)).alias(f"{k}_{'drop' if k != 'hr' else 'rise'}"))
        return F.struct(F.get(prefix, i)["idx"].alias("idx"), i.alias("place"), *signs)

    told = F.transform(F.when((width > 0) & (n > width), F.sequence(width, n - 1)).otherwise(F.array().cast("array<int>")), one)
    held = lambda w: sum((w[c].cast("int") for c in ("hr_rise", "cadence_drop", "power_drop")), w["pace_drop"].cast("int"))
    return F.transform(told, lambda w: w.withField("severity", F.least(F.lit(1.0), held(w) * 0.3)))


def with_fatigue(df: DataFrame, out: str = "fatigue", least: float = 0.5) -> DataFrame:
    """Adds whether, where and how strongly fatigue sets in, from ``prefix``: a sample with more than ``least`` severity, which takes two
    signs, is an event. Each step is a column of its own, so that nothing is worked out twice."""
    at = df.withColumn("_events", F.filter(fatigue_windows(F.col("prefix")), lambda w: w["severity"] > least))
    at = at.withColumns({"_size": F.size("_events"), "_first": F.get("_events", F.lit(0)), "_total": F.aggregate("_events", F.lit(0.0), lambda a, w: a + w["severity"])})
    at = at.withColumn("_at", F.get("prefix", F.col("_first.place")))
    index = half_up(half_up(F.col("_size") / F.size("prefix") * (F.col("_total") / F.col("_size")) * 100, 6)).cast("int")
    told = F.struct(
        (F.col("_size") > 0).alias("detected"), F.col("_first.idx").alias("onset_idx"), F.col("_at.km").alias("onset_km"), F.col("_at.second").alias("onset_seconds"), F.coalesce("_first.severity", F.lit(0.0)).alias("severity"),
        F.col("_size").alias("events"), F.when(F.col("_size") > 0, index).otherwise(0).alias("index"),
    )
    return at.withColumn(out, told).drop("_events", "_size", "_first", "_total", "_at")


def with_prefix(points: DataFrame) -> DataFrame:
    """A row for each activity with its ``prefix`` array. One exchange and one sort; the array is bounded by the activity's samples."""
    own = prefix_sums(deltas(points).withColumn("second", F.unix_timestamp("ts") - F.unix_timestamp(F.first("ts").over(so_far()))))
    return own.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sums", "km", "second"))).alias("prefix"))


def fatigue(points: DataFrame) -> DataFrame:
    """The signs of fatigue at each sample and their severity."""
    return with_prefix(points).select("activity_id", F.inline(fatigue_windows(F.col("prefix")))).drop("place")


def fatigue_summary(points: DataFrame) -> DataFrame:
    return with_fatigue(with_prefix(points)).select("activity_id", "fatigue.*")


def hampel(values: np.ndarray, half: int = 5, sigma: float = 2.5, in_place: bool = True) -> np.ndarray:
    """Outliers by upper median and unscaled median deviation replaced by the median. In place, later windows see earlier repairs."""
    out = values.astype(float).copy()
    seen = out if in_place else values.astype(float)
    for i in range(len(out)):
        if np.isnan(out[i]):
            continue
        near = seen[max(0, i - half) : i + half + 1]
        near = np.sort(near[~np.isnan(near)])
        if len(near) < 3:
            continue
        mid = near[len(near) // 2]
        mad = np.sort(np.abs(near - mid))[len(near) // 2]
        if mad > 0 and abs(out[i] - mid) > sigma * mad:
            out[i] = mid
    return out


def smooth_in_place(values: np.ndarray, width: int) -> np.ndarray:
    """Centred mean that reads its own results: each value is replaced before the next window is taken."""
    out, half = values.astype(float).copy(), width // 2
    for i in range(len(out)):
        if not np.isnan(out[i]):
            near = out[max(0, i - half) : i + half + 1]
            out[i] = np.nanmean(near)
    return out


def smooth_moving(values: np.ndarray, moving: np.ndarray, width: int) -> np.ndarray:
    """Centred mean over moving samples with a positive value, replaced in order; others stay."""
    out, half = values.astype(float).copy(), width // 2
    for i in range(len(out)):
        if moving[i] and out[i] > 0:
            low, high = max(0, i - half), i + half + 1
            near = out[low:high][moving[low:high] & (out[low:high] > 0)]
            out[i] = near.mean()
    return out


def without_spikes(steps: np.ndarray, lat: np.ndarray, lon: np.ndarray, longest: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples that jump more than ``longest`` km go to the middle of the repaired one before and the one after; the last to the one before."""
    steps, lat, lon = (x.astype(float).copy() for x in (steps, lat, lon))
    for i in range(1, len(steps)):
        if steps[i] > longest:
            for x in (steps, lat, lon):
                x[i] = (x[i - 1] + x[i + 1]) / 2 if i + 1 < len(x) else x[i - 1]
    return steps, lat, lon


def cleaned(points: DataFrame, in_place: bool = True) -> DataFrame:
    """Adds ``elevation_clean``, ``grade_smooth`` and ``speed_clean``, and repairs jumps of position where ``lat``, ``lon`` and
    ``d_km`` are given. The filters are recursive, so each activity is one pandas group, bounded by its samples."""
    schema = points.select("*", *[F.lit(0.0).alias(c) for c in ("elevation_clean", "grade_smooth", "speed_clean")]).schema
    placed = {"lat", "lon", "d_km"} <= set(points.columns)

    def one(samples: pd.DataFrame) -> pd.DataFrame:
        samples = samples.sort_values("idx")
        if placed:
            steps, lat, lon = without_spikes(*(samples[c].to_numpy() for c in ("d_km", "lat", "lon")))
            samples = samples.assign(d_km=steps, lat=lat, lon=lon)
        speed = hampel(samples["speed"].to_numpy(), in_place=in_place)
        return samples.assign(
            elevation_clean=smooth_in_place(hampel(samples["elevation"].to_numpy(), in_place=in_place), 5), grade_smooth=smooth_in_place(samples["grade"].to_numpy(), 7),
            speed_clean=smooth_moving(speed, samples["moving"].to_numpy().astype(bool), 7),
        )

    return points.groupBy("activity_id").applyInPandas(one, schema)


def bands(points: DataFrame, n: int = 40) -> DataFrame:
    """Minimum, mean and maximum speed in equal stretches of distance; empty stretches take the last one before."""
    own = deltas(points)
    longest = F.max("km").over(Window.partitionBy("activity_id"))
    cell = F.least(F.floor(F.col("km") / F.nullif(longest, F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    sums = own.withColumn("band", cell).where("band is not null").groupBy("activity_id", "band").agg(F.min("speed").alias("low"), exact_mean(F.col("speed")).alias("mean"), F.max("speed").alias("high"))
    every = sums.select("activity_id").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("activity_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(sums, ["activity_id", "band"], "left").select("activity_id", "band", *[F.last(c, True).over(w).alias(c) for c in ("low", "mean", "high")])
