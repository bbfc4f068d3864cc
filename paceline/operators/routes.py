"""Places along a route at which weather is looked up: evenly spread over its line, each with its time and bearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import bearing, half_up


def sample_count(vertices: Column, moving_time: Column) -> Column:
    """Five, one more for every twenty minutes, at most fourteen and the line's vertices; none for less than two vertices."""
    wanted = 5 + F.floor(F.coalesce(moving_time.cast("double"), F.lit(0.0)) / 60 / 20)
    return F.when(vertices < 2, 0).otherwise(F.greatest(F.lit(2), F.least(vertices, F.lit(14), wanted))).cast("int")


def samples(routes: DataFrame, line: str = "line", start: str = "start_ts", moving_time: str = "moving_time") -> DataFrame:
    """A row for each sample, with all other columns of ``routes``: ``sample`` (from 0), the vertex ``index``, ``lat``, ``lon``, ``progress``, ``at`` and ``bearing``.

    ``line`` is an array of (lat, lon). Samples are even in vertices, as recorded lines are even in time. The bearing is
    that of the edge ahead, at the last vertex that of the edge behind. A null line, or one of less than two vertices, has
    no samples; a null or zero moving time counts as a millisecond.
    """
    n, last = F.size(line), F.size(line) - 1
    count = sample_count(n, F.col(moving_time))
    millis = F.greatest(F.lit(1.0), F.coalesce(F.col(moving_time).cast("double"), F.lit(0.0)) * 1000)

    def one(i: Column) -> Column:
        progress = i / (count - 1)
        k = half_up(progress * last).cast("int")
        a, b = F.get(line, F.least(k, last - 1)), F.get(line, F.least(k + 1, last))
        here = F.get(line, k)
        return F.struct(k.alias("index"), here["lat"].alias("lat"), here["lon"].alias("lon"), progress.alias("progress"), half_up(progress * millis).alias("millis"), bearing(a["lat"], a["lon"], b["lat"], b["lon"]).alias("bearing"))

    spread = routes.where(n >= 2).select("*", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), one)).alias("sample", "_s"))
    at = F.col(start) + F.make_dt_interval(secs=(F.col("_s.millis") / 1000).cast("decimal(18,6)"))
    return spread.select(*[c for c in routes.columns if c != line], "sample", "_s.index", "_s.lat", "_s.lon", "_s.progress", at.alias("at"), "_s.bearing")
