"""Rolling, cumulative and ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(value: str, rows: int, keys: list[str], order: list[str]) -> Column:
    """Mean of the last ``rows`` rows, shorter at the start; nulls and NaN are passed over, 0 where nothing is left."""
    clean = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return F.coalesce(F.avg(clean).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)), F.lit(0.0))


def centred_mean(value: str, before: int, after: int, keys: list[str], order: list[str]) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after))


def running_total(value: str, keys: list[str], order: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def local_mean(df: DataFrame, value: str, keys: list[str], order: list[str], out: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """Mean of the neighbours by tricube weights, over a window that grows with the group: ``share`` of its rows, at least ``least``.

    A neighbour's weight is (1 - (d / (w/2))^3)^3 for its distance d in rows and the window w, zero from half the window on. A frame of
    rows can't follow the group's size, so each group's values, in order, are one array; a null value stays null and weighs nothing.
    """
    w = Window.partitionBy(*keys)
    numbered = df.withColumn("_i", F.row_number().over(w.orderBy(*order)))
    series = numbered.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("y")))), lambda p: p["y"]).alias("_y"))
    size = F.greatest(F.lit(float(least)), F.floor(F.size("_y") * share).cast("double"))
    half = F.floor(size / 2).cast("int")

    def weight(d: Column) -> Column:
        u = F.abs(d) / (size / 2)
        return F.when(u >= 1, 0.0).otherwise(F.pow(1 - F.pow(u, F.lit(3.0)), F.lit(3.0)))

    def mean(y: Column, i: Column) -> Column:
        near = F.filter(F.transform(F.sequence(-half, half), lambda d: F.struct(weight(d).alias("w"), F.when(i + d >= 0, F.get("_y", i + d)).alias("y"))), lambda p: p["y"].isNotNull())
        total = lambda f: F.aggregate(near, F.lit(0.0), lambda a, p: a + f(p))
        return F.when(y.isNotNull(), total(lambda p: p["w"] * p["y"]) / total(lambda p: p["w"]))

    smooth = series.select(*keys, F.posexplode(F.transform("_y", mean)).alias("_i", out)).withColumn("_i", F.col("_i") + 1)
    return numbered.join(smooth, [*keys, "_i"]).drop("_i")


def islands(df: DataFrame, inside: Column, keys: list[str], order: str) -> DataFrame:
    """Rows for which ``inside`` holds, numbered by maximal runs of neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    starts = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)
    numbered = flagged.withColumn("_start", starts).withColumn("island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("_in").drop("_in", "_start")


def every_nth(df: DataFrame, at_most: int, keys: list[str], order: list[str]) -> DataFrame:
    """Down-sampling by a stride of floor(n / at_most) rows, at least one."""
    w = Window.partitionBy(*keys)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumns({"_n": n, "_i": i}).where("_i % greatest(1, cast(floor(_n / {0}) as int)) = 0".format(at_most)).drop("_n", "_i")
