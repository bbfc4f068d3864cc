"""The ad-hoc activity query: filter, group by period, sort, project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Range = tuple[float | None, float | None]


def in_days(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Days from ``first`` to ``last``, both included; either may be open."""
    if first:
        df = df.where(F.col("day") >= F.lit(first).cast("date"))
    return df.where(F.col("day") <= F.lit(last).cast("date")) if last else df


def bounded(value: Column, limits: Range) -> Column:
    low, high = limits
    return (F.lit(True) if low is None else value >= low) & (F.lit(True) if high is None else value <= high)


@dataclass(frozen=True)
class ActivityQuery:
    """Null distances and durations count as 0; other nulls fail only where a bound is given."""

    sports: tuple[str, ...] = ()
    name: str | None = None
    first_day: str | None = None
    last_day: str | None = None
    distance_km: Range = (None, None)
    minutes: Range = (None, None)
    heart_rate: Range = (None, None)
    elevation: Range = (None, None)
    power: Range = (None, None)
    tss: Range = (None, None)
    period: str | None = None
    order_by: str | None = None
    descending: bool = True
    columns: tuple[str, ...] = ()

    def filtered(self, df: DataFrame) -> DataFrame:
        out = in_days(df, self.first_day, self.last_day)
        if self.sports:
            out = out.where(F.col("sport_type").isin(*self.sports))
        if self.name:
            out = out.where(F.lower("name").contains(self.name.lower()))
        for column, limits, scale, zero in (
            ("distance", self.distance_km, 1000.0, True), ("moving_time", self.minutes, 60.0, True), ("average_heartrate", self.heart_rate, 1.0, False),
            ("total_elevation_gain", self.elevation, 1.0, False), ("average_watts", self.power, 1.0, False), ("tss", self.tss, 1.0, False),
        ):
            if limits != (None, None):
                value = F.coalesce(F.col(column), F.lit(0)) if zero else F.col(column)
                out = out.where(bounded(value / scale, limits))
        return out

    def run(self, df: DataFrame) -> DataFrame:
        from paceline.operators.aggregates import by_period

        out = self.filtered(df)
        if self.period:
            kinds = dict(out.dtypes)
            numbers = [c for c, t in kinds.items() if t in ("int", "bigint", "double", "float") and not c.endswith("id")]
            out = by_period(out, self.period, numbers, [c for c, t in kinds.items() if t == "string"])
        if self.order_by:
            column = F.col(self.order_by)
            out = out.orderBy(column.desc_nulls_last() if self.descending else column.asc_nulls_first())
        return out.select(*self.columns) if self.columns else out
