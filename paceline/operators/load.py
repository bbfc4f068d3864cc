"""Training load: stress scores, the daily model, risk, readiness and recovery. Everything is per athlete."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import clamp, half_up, present, sport_category

# Stress multipliers by sport (0.80 otherwise), weights of heart-rate zones, recovery factors by sport (1.0 otherwise).
STRESS_BY_SPORT = {
    "Run": 1.07, "VirtualRun": 1.05, "TrailRun": 1.15, "Ride": 0.78, "VirtualRide": 0.66, "GravelRide": 0.80, "MountainBikeRide": 0.85, "EBikeRide": 0.71,
    "Swim": 0.75, "PoolSwim": 0.75, "OpenWaterSwim": 2.0, "Soccer": 1.05, "Hike": 0.93, "Walk": 0.52, "WeightTraining": 0.73, "Workout": 0.78, "HIIT": 1.15,
    "Crossfit": 1.10, "Yoga": 0.35, "AlpineSki": 0.62, "NordicSki": 0.80, "Snowboard": 0.58, "Rowing": 0.82, "Kayaking": 0.70, "IceSkate": 0.65,
}
ZONE_WEIGHTS = (0.40, 0.55, 0.72, 0.88, 1.05)
RECOVERY_BY_SPORT = {
    "Run": 1.2, "TrailRun": 1.5, "Ride": 0.9, "MountainBikeRide": 1.1, "Swim": 0.7, "WeightTraining": 1.0, "Soccer": 1.1, "Padel": 0.8, "AlpineSki": 0.8, "Hike": 0.7,
    "Rowing": 1.0, "Walk": 0.4, "Workout": 0.8, "VirtualRun": 1.1, "VirtualRide": 0.85, "GravelRide": 0.95, "EBikeRide": 0.75,
}
MAX_HR = 190.0


def looked_up(key: Column, values: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*values.items())))[key], F.lit(otherwise))


def zone_intensity(hr: Column, zones: list[tuple[float, float]]) -> Column:
    """Weight of the zone that holds ``hr``, carried linearly towards the next zone's; outside all zones the last weight."""
    out = F.lit(ZONE_WEIGHTS[-1])
    for k, (low, high) in reversed(list(enumerate(zones))):
        weight, after = ZONE_WEIGHTS[min(k, 4)], ZONE_WEIGHTS[min(k + 1, 4)]
        width = 20.0 if high == -1 else high - low
        inside = (hr >= low) if high == -1 else (hr >= low) & (hr < high)
        out = F.when(inside, weight + (hr - low) / width * (after - weight)).otherwise(out)
    return out


def stress(df: DataFrame, zones: list[tuple[float, float]] | None = None, max_hr: float = MAX_HR, suffer: float = 1.0) -> DataFrame:
    """Adds ``tss`` (two decimals) and ``tss_method``: by power, heart-rate zones or ratio, suffer score, else time."""
    hours = F.coalesce(F.col("moving_time"), F.lit(0)) / 3600.0
    hr, mult = F.col("average_heartrate"), looked_up(F.col("sport_type"), STRESS_BY_SPORT, 0.80)
    by_power = F.lit(False)
    power = F.lit(0.0)
    if {"average_watts", "ftp"} <= set(df.columns):
        by_power = (F.col("average_watts") > 0) & (F.col("ftp") > 0)
        power = F.pow(F.col("average_watts") / F.col("ftp"), 2)
    by_hr, by_suffer = hr > 0, F.col("suffer_score") > 0
    intensity = zone_intensity(hr, zones) if zones else F.pow(hr / max_hr, F.lit(2.0))
    raw = F.when(by_power, hours * power * 100 * mult).when(by_hr, hours * intensity * 100 * mult).when(by_suffer, F.col("suffer_score") * suffer * mult).otherwise(hours * 36 * mult)
    taper = F.when((hours > 4) & (hr > 0) & (hr / max_hr < 0.7), F.greatest(F.lit(0.7), 1 - 0.05 * (hours - 4))).otherwise(1.0)
    method = F.when(by_power, "power").when(by_hr, "heartrate_zones" if zones else "heartrate").when(by_suffer, "suffer_score").otherwise("time")
    idle = hours <= 0
    return df.withColumns({"tss": F.when(idle, 0.0).otherwise(F.floor(raw * taper * 100 + 0.5) / 100), "tss_method": F.when(idle, "none").otherwise(method)})


def vo2max(df: DataFrame, max_hr: float = MAX_HR) -> DataFrame:
    speed = F.col("distance") / F.col("moving_time") * 60
    value = (-4.60 + 0.182258 * speed + 0.000104 * speed * speed) / F.coalesce(F.nullif(F.col("average_heartrate"), F.lit(0.0)) / max_hr, F.lit(0.8))
    fit = (F.col("sport_type") == "Run") & present(F.col("distance")) & (F.col("moving_time") >= 600) & (value > 25) & (value < 90)
    return df.withColumn("vo2max", F.when(fit, value))


def efficiency(df: DataFrame) -> DataFrame:
    """Pace (run, swim) or speed (bike) per beat, and which of them."""
    kind, hr, t, d = sport_category(F.col("sport_type")), F.col("average_heartrate"), F.col("moving_time"), F.col("distance")
    usable = (hr > 0) & (d > 0) & (t > 0)
    value = F.when(kind == "run", t / 60.0 / (d / 1000.0) / hr).when(kind == "swim", t / 60.0 / (d / 100.0) / hr).when(kind == "bike", d / 1000.0 / (t / 3600.0) / hr)
    name = F.when(kind == "run", "pace_per_hr").when(kind == "swim", "pace100m_per_hr").when(kind == "bike", "speed_per_hr")
    return df.withColumns({"efficiency": F.when(usable, value), "efficiency_method": F.when(usable, name)})


def recovery(df: DataFrame, max_hr: float = MAX_HR, tsb: str | None = None) -> DataFrame:
    """Adds ``recovery_hours`` (4 to 96); ``tsb`` names a form column that adds a day's or half a day's rest."""
    share = F.col("average_heartrate") / max_hr
    zone = F.when(~present(F.col("average_heartrate")), 1.0).when(share < 0.6, 0.6).when(share < 0.7, 0.85).when(share < 0.8, 1.0).when(share < 0.9, 1.25).otherwise(1.5)
    load = F.coalesce(F.nullif(F.col("tss"), F.lit(0.0)), F.lit(30.0))
    hours = F.coalesce(F.nullif(F.col("moving_time"), F.lit(0)), F.lit(3600)) / 3600.0
    raw = load * looked_up(F.col("sport_type"), RECOVERY_BY_SPORT, 1.0) * zone * F.sqrt(hours) / 10
    if tsb:
        raw = raw + F.when(F.col(tsb) <= -20, 24.0).when(F.col(tsb) <= -10, 12.0).otherwise(0.0)
    return df.withColumn("recovery_hours", F.floor(clamp(raw, 4.0, 96.0) + 0.5).cast("int"))


def daily_recovery(df: DataFrame) -> DataFrame:
    """A day's recovery: its longest counts 0.7 and the shorter ones 0.3 together, plus 12 % per further activity; 96 at most."""
    top = df.withColumn("most", F.max("recovery_hours").over(Window.partitionBy("athlete_id", "day")))
    day = top.groupBy("athlete_id", "day").agg(F.count("*").alias("n"), F.max("most").alias("most"), F.sum(F.when(F.col("recovery_hours") != F.col("most"), F.col("recovery_hours")).otherwise(0)).alias("rest"))
    several = F.floor(F.least((F.col("most") * 0.7 + F.col("rest") * 0.3) * (1 + (F.col("n") - 1) * 0.12), F.lit(96.0)) + 0.5)
    return day.select("athlete_id", "day", F.when(F.col("n") == 1, F.col("most")).otherwise(several).cast("int").alias("recovery_hours"))


def daily_load(df: DataFrame, value: str = "tss") -> DataFrame:
    return df.groupBy("athlete_id", "day").agg(F.sum(value).alias("load"), F.count("*").alias("n"))


def by_day(*ends: int) -> Window:
    return Window.partitionBy("athlete_id").orderBy("day").rowsBetween(*ends)


def fitness_and_fatigue(daily: DataFrame, calendar: bool = False) -> DataFrame:
    """ATL and CTL as trailing means over 7 and 42 rows, TSB their difference and ramp the change of CTL, both to one decimal.

    Rows are active days; with ``calendar`` rest days count as rows without load.
    """
    rows = on_every_day(daily, ["load"]) if calendar else daily
    exact = F.col("load").cast("decimal(18,6)")  # an exact sum is the same in whatever order it is taken
    mean = lambda n: F.sum(exact).over(by_day(1 - n, 0)).cast("double") / F.count("load").over(by_day(1 - n, 0))
    at = rows.withColumns({"atl": mean(7), "ctl": mean(42)})
    before = F.lag("ctl").over(Window.partitionBy("athlete_id").orderBy("day"))
    return at.withColumns({"tsb": half_up(F.col("ctl") - F.col("atl"), 1), "ramp": half_up(F.coalesce(F.col("ctl") - before, F.lit(0.0)), 1)})


def on_every_day(daily: DataFrame, sums: list[str]) -> DataFrame:
    """A row for every day between an athlete's first and last, missing sums as zero."""
    spine = daily.groupBy("athlete_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("athlete_id", F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(daily, ["athlete_id", "day"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in sums})


def seven_day_load(model: DataFrame) -> DataFrame:
    """Rolling seven calendar days of load; fitness and fatigue carried forward over rest days."""
    dense = on_every_day(model, ["load"])
    carry = {c: F.last(c, ignorenulls=True).over(by_day(Window.unboundedPreceding, 0)) for c in ("atl", "ctl", "tsb")}
    return dense.withColumns({"load7": F.sum("load").over(by_day(-6, 0)), **carry})


def stability(dense: DataFrame) -> DataFrame:
    """Seven-day load against the mean of its last 28 values, and the score of that ratio."""
    base = F.avg("load7").over(by_day(-27, 0))
    r = F.col("load7") / F.col("baseline")
    score = (
        F.when(F.col("baseline") <= 0, 0.65).when((r >= 0.9) & (r <= 1.3), 1.0).when(r < 0.9, F.greatest(F.lit(0.58), 0.88 - (0.9 - r) * 0.6))
        .when(r > 1.4, F.greatest(F.lit(0.0), 0.72 - (r - 1.4) * 0.9)).otherwise(0.82)
    )
    return dense.withColumn("baseline", base).withColumn("stability", score)


def folded(df: DataFrame, value: str, out: str, step: Callable[[float | None, float], float]) -> DataFrame:
    """``athlete_id, day, out``: each athlete's days in order, folded with ``step(previous, now)``; the previous of the first day
    is None, missing values stay missing and are passed over. Recursive, so an athlete's days are one group, bounded by days."""

    def one(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day")
        last, results = None, []
        for x in days["x"].tolist():
            if x is not None and x == x:
                last = step(last, x)
                results.append(last)
            else:
                results.append(None)
        return pd.DataFrame({"athlete_id": days["athlete_id"], "day": days["day"], out: results})

    kind = df.schema["athlete_id"].dataType.simpleString()
    return df.select("athlete_id", "day", F.col(value).cast("double").alias("x")).groupBy("athlete_id").applyInPandas(one, f"athlete_id {kind}, day date, {out} double")


def exponential(daily: DataFrame, value: str, days: int, out: str) -> DataFrame:
    """Exponential moving average, alpha = 1/days, over each athlete's days in order, starting from zero."""
    return folded(daily, value, out, lambda last, x: (last or 0.0) + (x - (last or 0.0)) / days)


def share_at_most(values: Column, x: Column) -> Column:
    return F.coalesce(F.size(F.filter(values, lambda v: v <= x)) / F.nullif(F.size(values), F.lit(0)), F.lit(0.5))


def raw_risk(model: DataFrame) -> DataFrame:
    """Risk before smoothing: ranks of form, ramp and fatigue in their recent frames, raised by uneven load."""
    frames = model.withColumns({
        "t": F.collect_list("tsb").over(by_day(-42, 0)), "r": F.collect_list("ramp").over(by_day(-14, 0)), "a": F.collect_list("atl").over(by_day(-7, 0)),
        "mean7": F.avg("load").over(by_day(-6, 0)), "sd7": F.stddev_pop("load").over(by_day(-6, 0)), "n7": F.count("load").over(by_day(-6, 0)),
    })
    tired = 1 - share_at_most(F.col("t"), F.col("tsb"))
    base = 0.6 * F.pow(tired, F.lit(1.5)) + 0.25 * F.pow(share_at_most(F.col("r"), F.col("ramp")), F.lit(1.3)) * tired + 0.15 * F.pow(share_at_most(F.col("a"), F.col("atl")), F.lit(1.2))
    uneven = F.when((F.col("n7") > 1) & (F.col("mean7") > 0), 1 + F.least(F.col("sd7") / F.col("mean7"), F.lit(1.0)) * 0.3).otherwise(1.0)
    return frames.withColumn("raw_risk", clamp(base * uneven, 0.0, 1.0)).drop("t", "r", "a", "mean7", "sd7", "n7")


def risk(model: DataFrame) -> DataFrame:
    """Risk with adaptive smoothing: the larger the change, the more of it counts; three decimals at each step."""

    def step(before: float | None, now: float) -> float:
        if before is None:
            return now
        alpha = 0.2 + 0.5 * min(1.0, abs(now - before))
        return math.floor((before * (1 - alpha) + now * alpha) * 1000 + 0.5) / 1000

    return folded(raw_risk(model), "raw_risk", "risk", step)


def form_score(tsb: Column, fatigue: float = -15.0, deep: float = -30.0) -> Column:
    return F.when(tsb >= 15, 1.0).when(tsb >= 5, 0.92).when(tsb >= -5, 0.74).when(tsb >= fatigue, 0.56).when(tsb >= deep, 0.36).otherwise(0.16)


def fatigue_score(atl: Column, ctl: Column) -> Column:
    d = F.coalesce(atl, F.lit(0.0)) - F.coalesce(ctl, F.lit(0.0))
    return F.when(d <= -6, 0.22).when(d <= 4, 0.34).when(d <= 12, 0.56).when(d <= 22, 0.80).otherwise(1.0)


def band_score(load7: Column, low: Column, high: Column) -> Column:
    """One within the week's productive load; outside less, sooner above it than below."""
    width = F.greatest(F.lit(1.0), high - low)
    under, over = F.greatest(F.lit(0.28), 1 - (low - load7) / (width * 0.95 + 12)), F.greatest(F.lit(0.0), 1 - (load7 - high) / (width * 0.7 + 10))
    return F.when(load7 < low, under).when(load7 > high, over).otherwise(1.0)


def hrv_score(nightly: Column, avg7: Column, low: Column, high: Column) -> Column:
    """Nightly heart-rate variability and its weekly mean against their reference band, and how far they lie apart; null without a nightly value."""
    width, mean = F.greatest(F.lit(6.0), F.coalesce(high, F.lit(0.0)) - F.coalesce(low, F.lit(0.0))), F.coalesce(avg7, nightly)
    away = lambda v: F.when(v < low, low - v).when(v > high, v - high).otherwise(0.0)
    part = lambda v, share, plus: F.when(away(v) == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - away(v) / (width * share + plus)))
    steady = F.greatest(F.lit(0.35), 1 - F.abs(nightly - mean) / (width + 10))
    return F.when(nightly.isNotNull(), clamp(part(mean, 0.9, 8) * 0.5 + part(nightly, 0.75, 6) * 0.35 + steady * 0.15, 0.0, 1.0))


def readiness_scores(dense: DataFrame, hrv: DataFrame | None = None) -> DataFrame:
    """``dense`` (the seven-day load with its stability) with the scores of form, fitness, freshness, load and, where ``hrv`` has the day, variability,
    each from 0 to 1, and ``blend``, their weighted sum from 0 to 100.

    ``hrv`` has ``athlete_id, day, nightly, avg7, reference_low, reference_high``, a row for each day. Fitness is its rank among all the athlete's days.
    """
    from paceline.operators.reports import acute_band

    at = acute_band(dense)
    rank = F.cume_dist().over(Window.partitionBy("athlete_id").orderBy(half_up(F.col("ctl"), 6)))
    at = at.withColumns({
        "form": form_score(F.col("tsb")), "fitness": clamp(0.25 + rank * 0.9, 0.0, 1.0), "freshness": 1 - fatigue_score(F.col("atl"), F.col("ctl")),
        "load_score": clamp(F.col("stability") * 0.65 + band_score(F.col("load7"), F.col("band_low"), F.col("band_high")) * 0.35, 0.0, 1.0),
    })
    plain = 0.35 * F.col("form") + 0.25 * F.col("fitness") + 0.20 * F.col("freshness") + 0.20 * F.col("load_score")
    if hrv is None:
        return at.withColumns({"hrv": F.lit(None).cast("double"), "blend": clamp(plain, 0.0, 1.0) * 100})
    told = hrv.select("athlete_id", "day", hrv_score(*(F.col(c) for c in ("nightly", "avg7", "reference_low", "reference_high"))).alias("hrv"))
    full = 0.30 * F.col("form") + 0.22 * F.col("fitness") + 0.18 * F.col("freshness") + 0.15 * F.col("load_score") + 0.15 * F.col("hrv")
    return at.join(told, ["athlete_id", "day"], "left").withColumn("blend", clamp(F.when(F.col("hrv").isNull(), plain).otherwise(full), 0.0, 1.0) * 100)


def readiness(dense: DataFrame, hrv: DataFrame | None = None, most: float = 8.0) -> DataFrame:
    """Readiness from 0 to 100: the blend of ``readiness_scores``, a centred mean of five days, and no more than ``most`` points of change a day."""
    centred = readiness_scores(dense, hrv).withColumn("centred", F.avg("blend").over(by_day(-2, 2)))
    return folded(centred, "centred", "readiness", lambda before, now: now if before is None else before + max(-most, min(most, now - before)))
