"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query ``f(spark, sf_dir)`` under its name, with SQL for the same rows where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def number(x: str, digits: int) -> str:
    """SQL that rounds half up, as ``scalars.half_up`` does."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"floor(({x}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale}"


def exact(x: str) -> str:
    """SQL of ``scalars.exact_mean``: a mean that doesn't depend on the order of the rows."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE) / count({x})"
