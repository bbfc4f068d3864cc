"""Summaries that dashboards and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import percent_change, ratio, week_start, wind_relation


def window_kpis(df: DataFrame, keys: list[str], end: str, days: int, measures: dict[str, Column]) -> DataFrame:
    """Sums over the last ``days`` days up to ``end`` and over as many before, with the change in percent (null from zero).
    One pass: both windows are conditions of the same group-by."""
    last = F.lit(end).cast("date")
    age = F.datediff(last, F.col("day"))
    now, before = (age >= 0) & (age < days), (age >= days) & (age < 2 * days)
    sums = [F.coalesce(F.sum(F.when(c, m)), F.lit(0.0)).alias(f"{n}_{w}") for n, m in measures.items() for w, c in (("now", now), ("before", before))]
    out = df.where(now | before).groupBy(*keys).agg(F.count_if(now).alias("n_now"), F.count_if(before).alias("n_before"), *sums)
    return out.withColumns({f"{n}_change": percent_change(F.col(f"{n}_now"), F.col(f"{n}_before")) for n in measures})


def sport_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sports that make up at least 15 % of the activities (gym 25 %) and the profile they form."""
    gym = F.col("sport_type").isin("WeightTraining", "Workout", "Crossfit", "HIIT", "Yoga")
    kinds = {"run": F.col("sport_type").rlike("(?i)run"), "ride": F.col("sport_type").rlike("(?i)ride|bike"), "swim": F.col("sport_type").rlike("(?i)swim"), "gym": gym}
    shares = df.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.count_if(c) / F.count("*")).alias(k) for k, c in kinds.items()])
    active = {k: F.col(k) >= (0.25 if k == "gym" else 0.15) for k in kinds}
    count = sum((a.cast("int") for a in active.values()), F.lit(0))
    profile = F.when(count >= 3, "triathlete").when(count == 2, "mixed").when(active["run"], "runner").when(active["ride"], "cyclist").when(active["swim"], "swimmer").when(active["gym"], "gym").otherwise("general")
    return shares.withColumn("profile", profile)


def acute_band(model: DataFrame) -> DataFrame:
    """The week's load that suits a fitness: 0.75 to 1.30 times seven days of it, at least 30 wide, weekly base at least 10."""
    base = F.greatest(F.col("ctl") * 7, F.lit(10.0))
    low, high = base * 0.75, base * 1.30
    mid, half = (low + high) / 2, F.greatest(high - low, F.lit(30.0)) / 2
    return model.withColumns({"band_low": F.greatest(F.lit(0.0), mid - half), "band_high": mid + half})


def goal_progress(df: DataFrame, keys: list[str], year: int, goal: float, value: str = "distance") -> DataFrame:
    """Twelve months of a year: cumulated value, the linear plan, and what is missing to the goal."""
    months = df.select(*keys).distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    sums = df.where(F.year("day") == year).groupBy(*keys, F.month("day").alias("month")).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = months.join(sums, [*keys, "month"], "left").withColumn("so_far", F.sum(F.coalesce("v", F.lit(0.0))).over(w))
    return out.select(*keys, "month", "so_far", (F.col("month") * goal / 12).alias("plan"), F.greatest(F.lit(0.0), goal - F.col("so_far")).alias("missing"))


def density(df: DataFrame, lat: Column, lon: Column, digits: int = 2) -> DataFrame:
    scale = float(10**digits)
    cell = lambda c: F.floor(c * scale + 0.5) / scale
    return df.groupBy(cell(lat).alias("lat"), cell(lon).alias("lon")).agg(F.count("*").alias("n"))


def seasonal(df: DataFrame, around: str, within: int, values: list[str]) -> DataFrame:
    """Means over rows of other years whose date, taken in one leap year, lies within ``within`` days of the given date.
    The turn of the year is not bridged."""
    flat = lambda d: F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d))
    day = F.lit(around).cast("date")
    near = df.where((F.abs(F.datediff(flat(F.col("day")), flat(day))) <= within) & (F.year("day") != F.year(day)))
    return near.agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def heart_rate_bins(df: DataFrame, keys: list[str], bins: list[int]) -> DataFrame:
    """Mean pace (min/km) by heart-rate bin in the first and the last third of an athlete's runs; a rate halfway between
    two bins counts in neither."""
    w = Window.partitionBy(*keys)
    third = F.floor(F.count("*").over(w) / 3)
    rn = F.row_number().over(w.orderBy("day", "id"))
    part = F.when(rn <= third, "first").when(rn > F.count("*").over(w) - third, "last")
    hit = F.filter(F.array(*map(F.lit, bins)), lambda b: F.abs(F.col("average_heartrate") - b) < 2.5)
    rows = df.withColumn("part", part).where("part is not null").withColumn("bin", F.explode(hit))
    return rows.groupBy("part", "bin").agg(F.count("*").alias("n"), F.avg(F.col("moving_time") / 60.0 / (F.col("distance") / 1000.0)).alias("pace"))


def training_summary(df: DataFrame, keys: list[str], as_of: str, weeks: int = 8) -> DataFrame:
    """The last weeks before a day: mean and largest weekly km, longest run, weeks with runs, and their share."""
    since = F.date_sub(F.lit(as_of).cast("date"), 7 * weeks)
    recent = df.where((F.col("day") > since) & (F.col("day") <= F.lit(as_of).cast("date")))
    week = recent.groupBy(*keys, week_start(F.col("day")).alias("week")).agg(F.sum("distance").alias("d"), F.max("distance").alias("longest"))
    return week.groupBy(*keys).agg(F.count("*").alias("active_weeks"), F.avg(F.col("d") / 1000).alias("mean_km"), F.max(F.col("d") / 1000).alias("max_km"), F.max(F.col("longest") / 1000).alias("longest_km"), (F.count("*") / float(weeks)).alias("consistency"))


def wind_summary(samples: DataFrame, keys: list[str], route: Column, wind_from: Column) -> DataFrame:
    """How many samples have the wind from behind, ahead or aside, and which prevails (tail, head, then cross among equals)."""
    told = samples.withColumn("_r", wind_relation(route, wind_from))
    out = told.groupBy(*keys).agg(*[F.count_if(F.col("_r") == k).alias(k) for k in ("tail", "head", "cross")])
    most = F.greatest("tail", "head", "cross")
    return out.withColumn("main", F.when(F.col("tail") == most, "tail").when(F.col("head") == most, "head").otherwise("cross"))


def workout_class(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Trail, long (a distance of the upper fifth, not a race), race, hard or easy against the mean load, else other.

    The upper fifth starts at the sorted distance at floor(0.8 n)."""
    w = Window.partitionBy(*keys)
    at = F.least(F.floor(F.count("distance").over(w) * 0.8), F.count("distance").over(w) - 1)
    ranked = runs.withColumn("_mean", F.avg("tss").over(w)).withColumns({"_at": at, "_k": F.row_number().over(w.orderBy(F.asc_nulls_last("distance"))) - 1})
    ranked = ranked.withColumn("_long", F.max(F.when(F.col("_k") == F.col("_at"), F.col("distance"))).over(w))
    race = F.coalesce(F.col("workout_type") == 1, F.lit(False))
    kind = (
        F.when(F.col("sport_type") == "TrailRun", "trail").when((F.col("distance") >= F.col("_long")) & ~race, "long").when(race, "race").when(F.col("tss") > 1.5 * F.col("_mean"), "hard")
        .when(F.col("tss") < 0.5 * F.col("_mean"), "easy").otherwise("other")
    )
    return ranked.withColumn("workout", kind).drop("_mean", "_long", "_at", "_k")


def track_stats(points: DataFrame) -> DataFrame:
    """Per track: samples, mean and upper median of speed, heart-rate mean, maximum and population deviation, mean power,
    shares of time in three grades of climb, and speed by beat."""
    w = Window.partitionBy("activity_id")
    ranked = points.withColumns({"_k": F.row_number().over(w.orderBy(F.asc_nulls_last("speed"))) - 1, "_m": F.floor(F.count("speed").over(w) / 2)})
    out = ranked.groupBy("activity_id").agg(
        F.count("*").alias("n"), F.avg("speed").alias("mean_speed"), F.max(F.when(F.col("_k") == F.col("_m"), F.col("speed"))).alias("median_speed"), F.avg("heart_rate").alias("mean_hr"), F.max("heart_rate").alias("max_hr"), F.stddev_pop("heart_rate").alias("sd_hr"),
        F.avg("power").alias("mean_power"), (F.count_if(F.col("grade") > 2) / F.count("*")).alias("up"), (F.count_if(F.col("grade") < -2) / F.count("*")).alias("down"),
    )
    return out.withColumn("speed_per_beat", ratio(F.col("mean_speed"), F.col("mean_hr")))


def zone_shares(points: DataFrame, zones: list[tuple[float, float]]) -> DataFrame:
    """Share of each heart-rate zone among a track's samples that have one."""
    from paceline.operators.joins import zone_of

    n = F.sum(F.count("*")).over(Window.partitionBy("activity_id"))
    return zone_of(points, F.col("heart_rate"), zones).groupBy("activity_id", "zone").agg(F.count("*").alias("n"), (F.count("*") / n).alias("share"))


def last_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, in the order given."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def extremes(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    high = df.orderBy(F.desc(value), tie).limit(n).withColumn("end", F.lit("top"))
    return high.unionByName(df.orderBy(F.asc(value), tie).limit(n).withColumn("end", F.lit("bottom")))


def best_in_window(df: DataFrame, keys: list[str], windows: dict[str, tuple[float, float]], speed: Column) -> list[Column]:
    """For each window of distance the day and speed of the fastest activity in it, the smallest id among equals."""
    found = []
    for name, (low, high) in windows.items():
        inside = F.when((F.col("distance") >= low) & (F.col("distance") <= high) & (speed > 0), F.struct(speed, -F.col("id")))
        found += [F.max_by("day", inside).alias(f"{name}_day"), F.max(F.when(inside.isNotNull(), speed)).alias(f"{name}_speed")]
    return found


def coach_context(df: DataFrame, keys: list[str], as_of: str, months: int = 12) -> DataFrame:
    """What a conversation about an athlete's training starts from, as one nested row: totals, sports by number of activities, best
    runs of about 5 and 10 km and the longest, the longest and fastest ride, and the volume of the last months.

    ``df`` has ``keys, id, day, sport_type, distance, moving_time, average_heartrate``. Lists are bounded by sports and months.
    """
    speed = F.col("distance") / F.nullif(F.col("moving_time"), F.lit(0))
    run, ride = F.col("sport_type").isin("Run", "TrailRun"), F.col("sport_type").isin("Ride", "VirtualRide", "GravelRide")
    sums = [F.count("*").alias("n"), F.sum(F.coalesce("distance", F.lit(0.0))).alias("distance"), F.sum(F.coalesce("moving_time", F.lit(0))).alias("seconds")]
    sports = df.groupBy(*keys, "sport_type").agg(*sums, F.avg(F.when(F.col("average_heartrate") > 0, F.col("average_heartrate"))).alias("hr"))
    by_sport = sports.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "sport_type", "n", "distance", "seconds", "hr"))), lambda s: s.dropFields("k")).alias("sports"))
    since = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), 1 - months)
    recent = df.where((F.col("day") >= since) & (F.col("day") <= F.lit(as_of).cast("date"))).groupBy(*keys, F.trunc("day", "month").alias("month")).agg(*sums)
    by_month = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("month", "n", "distance", "seconds"))).alias("months"))
    longest = lambda held: F.max_by(F.struct("day", "distance"), F.when(held, F.struct(F.coalesce("distance", F.lit(0.0)), -F.col("id"))))
    whole = df.groupBy(*keys).agg(
        *sums, F.min("day").alias("first_day"), F.max("day").alias("last_day"), longest(run).alias("longest_run"), longest(ride).alias("longest_ride"),
        F.max_by(F.struct("day", speed.alias("speed")), F.when(ride & speed.isNotNull(), F.struct(speed, -F.col("id")))).alias("fastest_ride"),
    )
    runs = df.where(run).groupBy(*keys).agg(*best_in_window(df, keys, {"best_5k": (4800.0, 5500.0), "best_10k": (9500.0, 10500.0)}, speed))
    return whole.join(runs, keys, "left").join(by_sport, keys).join(by_month, keys, "left")
