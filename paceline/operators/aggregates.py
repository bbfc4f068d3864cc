"""Group-bys over activities: periods, matrices, histograms, Eddington numbers, fits and percentiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUNCATION = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def period_start(day: Column, period: str) -> Column:
    return F.date_trunc(TRUNCATION[period], day).cast("date")


def spine(df: DataFrame, period: str, keys: list[str], day: str = "day") -> DataFrame:
    """Every period between each key's first and last day."""
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}[period]
    ends = df.groupBy(*keys).agg(period_start(F.min(day), period).alias("_a"), period_start(F.max(day), period).alias("_b"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias("period"))


def dense_volume(df: DataFrame, period: str, keys: list[str], value: str = "distance") -> DataFrame:
    """Sum of ``value`` and number of rows by period, periods without rows as zero."""
    sums = df.groupBy(*keys, period_start(F.col("day"), period).alias("period")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return spine(df, period, keys).join(sums, [*keys, "period"], "left").fillna({"total": 0.0, "n": 0})


def by_period(df: DataFrame, period: str, numbers: list[str], texts: list[str]) -> DataFrame:
    """The ad-hoc period group-by: rows, every number's sum, mean, minimum and maximum, every text's most frequent value
    (the first in order among equals, with ``<text>_tied``)."""
    keyed = df.withColumn("period", period_start(F.col("day"), period))
    sums = [f(c).alias(f"{c}_{name}") for c in numbers for name, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))]
    out = keyed.groupBy("period").agg(F.count("*").alias("n"), *sums)
    if not texts:
        return out
    # all text columns are stacked, so that any number of them is counted at once
    stacked = keyed.select("period", F.inline(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in texts))))
    counts = stacked.groupBy("period", "_c", "_v").agg(F.count("*").alias("_k"))
    tops = counts.groupBy("period", "_c", "_k").agg(F.min("_v").alias("_v"), (F.count("*") > 1).alias("_tied"))
    own = lambda c, v: F.max_by(v, F.when(F.col("_c") == c, F.col("_k")))
    modes = tops.groupBy("period").agg(*(x for c in texts for x in (own(c, "_v").alias(f"{c}_mode"), own(c, "_tied").alias(f"{c}_tied"))))
    return out.join(modes, "period", "left")


def matrix(df: DataFrame, row: Column, column: Column, values: list, value: Column | None = None) -> DataFrame:
    """Counts (or sums of ``value``) by two keys; the second becomes a column for each of ``values``, zero where empty."""
    cells = df.select(row.alias("row"), column.alias("col"), (value if value is not None else F.lit(1)).alias("v"))
    return cells.groupBy("row").pivot("col", values).agg(F.sum("v")).fillna(0)


def histogram(df: DataFrame, value: Column, low: float, width: float, bins: int, clamped: bool = False) -> DataFrame:
    """Fixed-width bins with a row for each bin. A value on the last edge is dropped, or with ``clamped`` falls into the last bin."""
    bin_ = F.floor((value - low) / width)
    if clamped:
        bin_ = F.least(bin_, F.lit(bins - 1))
    counts = df.where(value.isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("bin") * width + low).alias("from"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ten_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal bins between minimum and maximum, the last one closed; one bin where all values are equal."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def eddington(daily: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """Per key the largest E with at least E days of at least E units.

    Days are ranked from the longest: E is the number of days whose whole units reach their rank.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.floor(value)), "day"))
    return daily.withColumn("rank", rank).groupBy(*keys).agg(F.count_if(F.floor(value) >= F.col("rank")).alias("eddington"), F.count("*").alias("active_days"))


def eddington_series(daily: DataFrame, keys: list[str], value: str = "total", recent_days: int = 90, ahead: int = 10) -> DataFrame:
    """Per key and threshold up to the largest day: the days that reach it; once there are as many as the threshold, the day on which it was
    achieved and the days and active days it took; before, the active days it will have taken at the pace of the last ``recent_days`` days
    (for the next ``ahead`` thresholds, null where no recent day reaches it).

    Days are counted by their whole units and the counts added up from the top, and the achievement days are those on which the
    running Eddington number rises, so the work grows with days plus thresholds. A key's days are one group. Days below one unit are active days all the same.
    """
    kinds = ", ".join(f"{k} {daily.schema[k].dataType.simpleString()}" for k in keys)

    def one(key: tuple, days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day")
        units, day = days["u"].to_numpy(np.int64), pd.to_datetime(days["day"]).to_numpy("datetime64[D]")
        most, n = int(units.max(initial=0)), len(units)
        at_least = lambda u: np.cumsum(np.bincount(u, minlength=most + 1)[::-1])[::-1][1:]
        counts, recent = at_least(units), at_least(units[day > day[-1] - recent_days])
        seen, number, reach, took = np.zeros(most + 2, np.int64), 0, 0, []
        for i, u in enumerate(units):  # ``reach`` days so far have more than ``number`` units
            if u > number:
                seen[u] += 1
                reach += 1
                if reach > number:
                    number += 1
                    reach -= seen[number]
                    took.append(i)
        threshold = np.arange(1, most + 1)
        done = threshold <= number
        when = np.zeros(most, np.int64)
        when[: len(took)] = took
        spent = (day[when] - day[0]).astype(np.int64) + 1 if n else when
        active = int((day > day[-1] - recent_days).sum())
        soon = ~done & (threshold <= number + ahead) & (recent > 0)
        later = n + np.ceil((threshold - counts) * (active / np.maximum(recent, 1)))
        some = lambda v, held: pd.Series([int(x) if h else None for x, h in zip(v, held, strict=True)], dtype="object")
        out = pd.DataFrame({k: [v] * most for k, v in zip(keys, key, strict=True)})
        return out.assign(
            threshold=threshold, days=counts, achieved=pd.Series([day[w].astype(object) if h else None for w, h in zip(when, done, strict=True)], dtype="object"), days_needed=some(spent, done), active_days_needed=some(when + 1, done),
            projected_active_days=some(np.where(done, when + 1, later), done | soon),
        )

    schema = f"{kinds}, threshold int, days long, achieved date, days_needed long, active_days_needed long, projected_active_days long"
    return daily.select(*keys, "day", F.greatest(F.lit(0), F.floor(value)).cast("long").alias("u")).groupBy(*keys).applyInPandas(one, schema)


def eddington_steps(daily: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """Per key and threshold: days that reach it, and the day on which it was achieved (its threshold-th such day)."""
    return eddington_series(daily, keys, value).select(*keys, "threshold", "days", "achieved")


def streaks(df: DataFrame, keys: list[str], period: str = "day") -> DataFrame:
    """Runs of consecutive days, weeks or months with activity: start, end and length, by gaps and islands."""
    at = period_start(F.col("day"), period)
    number = {"day": F.datediff("at", F.lit("1970-01-05").cast("date")), "week": F.datediff("at", F.lit("1970-01-05").cast("date")) / 7, "month": F.year("at") * 12 + F.month("at")}[period]
    seen = df.select(*keys, at.alias("at")).distinct().withColumn("k", number.cast("long"))
    island = F.col("k") - F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return seen.withColumn("island", island).groupBy(*keys, "island").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("length")).drop("island")


def gear_summary(uses: DataFrame) -> DataFrame:
    return uses.groupBy("gear_id").agg(
        F.count("*").alias("uses"), F.min("day").alias("first_use"), F.max("day").alias("last_use"), F.sum("km").alias("km"), F.avg("km").alias("mean_km"), F.sum("effort").alias("effort"),
        F.count_if(F.col("grade") > 0.05).alias("trail_uses"), F.countDistinct("day").alias("days"),
    )


def percentile_by_rule(values: Column, p: float, rule: str) -> Column:
    """A percentile of an array by one of four rules: floor (of p n), floor1 (of p (n-1)), nearest (rank), linear."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, F.greatest(F.lit(0), F.least(i, n - 1)).cast("int"))
    if rule == "floor":
        return at(F.floor(n * p))
    if rule == "floor1":
        return at(F.floor((n - 1) * p))
    if rule == "nearest":
        return at(F.floor((n - 1) * p + 0.5))
    x = (n - 1) * p
    return at(F.floor(x)) + (at(F.ceil(x)) - at(F.floor(x))) * (x - F.floor(x))


def percentiles(df: DataFrame, keys: list[str], value: str, rules: dict[str, tuple[float, str]]) -> DataFrame:
    """Percentiles by key by the rules of ``percentile_by_rule``, from ranks: no key's values are gathered."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_k": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    last = F.col("_n") - 1
    at = lambda i: F.max(F.when(F.col("_k") == F.greatest(F.lit(0), F.least(i, last)), F.col(value)))
    told = []
    for name, (p, rule) in rules.items():
        x = last * p
        if rule == "linear":
            low, high, part = at(F.floor(x)), at(F.ceil(x)), F.max(x - F.floor(x))
            told.append((low + (high - low) * part).alias(name))
        else:
            told.append(at({"floor": F.floor(F.col("_n") * p), "floor1": F.floor(x), "nearest": F.floor(x + 0.5)}[rule]).alias(name))
    return ranked.groupBy(*keys).agg(*told)


def quadratic_in_log(df: DataFrame, km: Column, y: Column, keys: list[str]) -> DataFrame:
    """Least squares of y = a + b ln(km) + c ln(km)^2 by key, from seven sums and Cramer's rule; null below three rows."""
    x = F.ln(km)
    s = df.where(km > 0).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)], *[F.sum(y * F.pow(x, F.lit(float(k)))).alias(f"t{k}") for k in range(3)])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    fit = lambda top: F.when((n >= 3) & (F.abs(whole) > 1e-9), top / whole)
    return s.select(*keys, "n", fit(det(t0, s1, s2, t1, s2, s3, t2, s3, s4)).alias("a"), fit(det(n, t0, s2, s1, t1, s3, s2, t2, s4)).alias("b"), fit(det(n, s1, t0, s1, s2, t1, s2, s3, t2)).alias("c"))


def volume_quintiles(monthly: DataFrame, keys: list[str], value: str = "total") -> DataFrame:
    """Months by volume in five groups of floor(n/5), the remainder in the last."""
    w = Window.partitionBy(*keys)
    rn = F.row_number().over(w.orderBy(value, "period"))
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / 5))
    return monthly.withColumn("quintile", F.least(F.floor((rn - 1) / size), F.lit(4)).cast("int"))
