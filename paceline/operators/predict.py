"""Records and race prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def records(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """Per key the id with the largest value of each metric, the smallest id among equals."""
    return df.groupBy(*keys).agg(*[F.max_by("id", F.struct(v, -F.col("id"))).alias(n) for n, v in metrics.items()], F.count("*").alias("n"))


def trimmed(predictions: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """Weighted mean of the predictions between two shares of their order by time; ``time, weight`` per row."""
    w = Window.partitionBy(*keys)
    k, n = F.row_number().over(w.orderBy("time")) - 1, F.count("*").over(w)
    kept = predictions.withColumns({"_k": k, "_n": n}).where(f"_k >= floor(_n * {start}D) and _k < ceil(_n * {end}D)")
    mean = F.sum(F.col("time") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))
    return kept.groupBy(*keys).agg(mean.alias("blended"), F.min("time").alias("low"), F.max("time").alias("high"), F.count("*").alias("n"))


def estimated_vdot(runs: DataFrame, keys: list[str], best: int = 5) -> DataFrame:
    """Mean of the best few VDOT values of runs of 3 km or more."""
    from paceline.functions.scalars import vdot

    scored = runs.where("distance >= 3000 and moving_time > 0").withColumn("v", vdot(F.col("distance"), F.col("moving_time"))).where("v > 10 and v < 100")
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "id"))
    return scored.withColumn("k", k).where(F.col("k") <= best).groupBy(*keys).agg(F.avg("v").alias("vdot"))
