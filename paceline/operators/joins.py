"""Range, nearest, interval and point-in-time joins, always with an equality to meet on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zone_of(df: DataFrame, value: Column, zones: list[tuple[float, float]]) -> DataFrame:
    """Joins each row to its zone [min, max), where -1 is open; rows outside all zones go. The zones are a literal list, so
    the join is an expression and moves no rows."""
    bounds = F.array(*[F.struct(F.lit(k + 1).alias("zone"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for k, (a, b) in enumerate(zones)])
    hit = F.filter(bounds, lambda z: (value >= z["low"]) & ((z["high"] == -1.0) | (value < z["high"])))
    return df.withColumn("zone", F.get(hit, F.lit(0))["zone"]).where("zone is not null")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each row of ``left`` the values of the row of ``right`` with the same keys that is nearest in time, the earlier of two equals.

    Both sides are put in one order per key, and the last row of ``right`` before and the first after are carried along:
    one shuffle and no pairing of every row with every other. Rows without a partner keep nulls.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(F.col(right_time).alias("t"), *values)).schema[0].dataType).alias("_r"))
    b = right.select(*[F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in left.dtypes], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_time).alias("t"), *values).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    back = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").asc())
    both = a.unionByName(b).withColumns({"_before": F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.last("_r", True).over(back.rowsBetween(Window.unboundedPreceding, 0))}).where("_side = 1")
    gap = lambda c: F.abs(F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col(f"{c}.t").cast("timestamp")))
    pick = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("_pick", pick).select(*left.columns, F.col("_pick.t").alias(f"nearest_{right_time}"), *[F.col(f"_pick.{v}").alias(v) for v in values])


def transitions(df: DataFrame, within: int, keys: list[str]) -> DataFrame:
    """Pairs of activities of one athlete where b starts at most ``within`` seconds after a ends and is another sport.

    Time is cut into slots of that length: a's end looks into its own slot and the next, so the join has an equality.
    """
    at = df.withColumns({"_start": F.unix_timestamp("start_ts"), "_end": F.unix_timestamp("start_ts") + F.col("elapsed_time")})
    a = at.select(*keys, F.col("id").alias("a"), F.col("sport_type").alias("from_sport"), "_end", F.explode(F.expr(f"array(floor(_end / {within}), floor(_end / {within}) + 1)")).alias("_slot"))
    b = at.select(*keys, F.col("id").alias("b"), F.col("sport_type").alias("to_sport"), "_start", F.floor(F.col("_start") / within).alias("_slot"))
    gap = F.col("_start") - F.col("_end")
    return a.join(b, [*keys, "_slot"]).where((gap >= 0) & (gap <= within) & (F.col("from_sport") != F.col("to_sport"))).select(*keys, "a", "b", "from_sport", "to_sport", gap.alias("gap"))


def within_bands(df: DataFrame, km: Column, targets: list[tuple[float, float]]) -> DataFrame:
    """Each row once for every target whose margin holds its distance; targets are a literal list."""
    bands = F.array(*[F.struct(F.lit(float(k)).alias("km"), F.lit(float(m)).alias("margin")) for k, m in targets])
    hit = F.filter(bands, lambda b: (km >= b["km"] * (1 - b["margin"])) & (km <= b["km"] * (1 + b["margin"])))
    return df.withColumn("_band", F.explode(hit)).withColumn("target", F.col("_band.km")).drop("_band")


def as_of_buckets(df: DataFrame, period: str, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """For each period the sums over all rows up to its end: period sums first, then running totals over them."""
    from paceline.operators.aggregates import period_start

    per = df.groupBy(*keys, period_start(F.col("day"), period).alias("period")).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*keys, "period", *[F.sum(c).over(w).alias(c) for c in [*sums, "n"]])
