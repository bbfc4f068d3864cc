"""Recursive averages over streams: state by athlete that is carried from day to day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000


def midnight(day: dt.date) -> int:
    """Milliseconds from the epoch to the end of a day."""
    return ((day - dt.date(1970, 1, 1)).days + 1) * DAY


class Fold(StatefulProcessor):
    """Loads of days that are still open, and the average up to the last closed day.

    A timer closes a day when the watermark passes its end. Then it is folded in, and all open days before it first, so
    days come out in order whatever the order of the rows. Rows of a day that is closed are too late and don't count.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day date", "load double")
        self.closed = handle.getValueState("closed", "day date, average double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.closed.get()[0] if self.closed.exists() else None
        for batch in rows:
            for day, load in batch.groupby("day")["load"].sum().items():
                if last is None or day > last:
                    if self.open.containsKey((day,)):
                        load += self.open.getValue((day,))[0]
                    else:
                        self.handle.registerTimer(midnight(day))
                    self.open.updateValue((day,), (float(load),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs()
        done = sorted((day, load) for (day,), (load,) in self.open.iterator() if midnight(day) <= ended)
        average = self.closed.get()[1] if self.closed.exists() else 0.0
        out = []
        for day, load in done:
            average += (load - average) / self.days
            out.append((key[0], day, load, average))
            self.open.removeKey((day,))
            self.closed.update((day, average))
        if out:
            yield pd.DataFrame(out, columns=["athlete_id", "day", "load", "average"])

    def close(self) -> None:
        pass


def exponential_load(events: DataFrame, value: str = "tss", days: int = 7, late: str = "2 days") -> DataFrame:
    """The exponential average of daily load, alpha 1/days, as ``load.exponential`` gives for a table: ``athlete_id, day, load, average``, a row when a day is closed.

    ``events`` is a stream with ``athlete_id, start_ts`` and ``value``. A day is closed when the watermark (the latest start less ``late``) has
    passed its end; rows before the watermark, or of closed days, are dropped. Null values count as zero, rows without an
    athlete or a start are passed over. State survives a restart from the checkpoint; it needs the RocksDB state store.
    """
    from pyspark.sql import functions as F

    rows = events.where("athlete_id is not null and start_ts is not null").withWatermark("start_ts", late)
    rows = rows.select("athlete_id", "start_ts", F.to_date("start_ts").alias("day"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("load"))
    key = rows.schema["athlete_id"].dataType.simpleString()
    return rows.groupBy("athlete_id").transformWithStateInPandas(Fold(days), f"athlete_id {key}, day date, load double, average double", "Append", "EventTime")
