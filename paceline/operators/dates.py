"""Date windows worked out on the driver: arguments of filters, so partitions are pruned."""

from __future__ import annotations

from datetime import date, timedelta

PRESETS = ("week", "last7", "month", "last30", "last3m", "last6m", "year", "last365", "alltime")


def months_back(day: date, months: int) -> date:
    """The same day some months before; days that month lacks run over into the next."""
    y, m = divmod(day.year * 12 + day.month - 1 - months, 12)
    first = date(y, m + 1, 1)
    return first + timedelta(days=day.day - 1)


def preset_start(preset: str, as_of: date, earliest: date | None = None) -> date:
    if preset == "week":
        return as_of - timedelta(days=as_of.weekday())
    if preset in ("month", "year"):
        return as_of.replace(day=1) if preset == "month" else as_of.replace(month=1, day=1)
    if preset in ("last3m", "last6m"):
        return months_back(as_of, int(preset[4]))
    if preset == "alltime":
        return earliest or as_of
    if preset in ("last7", "last30", "last365"):
        return as_of - timedelta(days=int(preset[4:]))
    raise ValueError(f"unknown preset {preset!r}")


def window(preset: str, as_of: date, earliest: date | None = None, low: date | None = None, high: date | None = None, custom: tuple[date, date] | None = None) -> tuple[date, date]:
    """First and last day: a custom pair as it is, else the preset's, clamped to ``low`` and ``high``; never turned round."""
    if custom:
        return custom
    start, end = preset_start(preset, as_of, earliest), as_of
    start = max(start, low) if low else start
    end = min(end, high) if high else end
    return min(start, end), end
