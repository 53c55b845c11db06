"""Named queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Both engines sum in different orders. The nudge keeps exact decimal ties, which means of
# two-decimal values hit often, off the rounding boundary where the last bit would decide.
NUDGE = 2.718281e-9


def r6(c: Column | str) -> Column:
    """Six decimals as a double; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + NUDGE, 6) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {NUDGE}, 6) + 0.0)"


def as_text(c: Column | str, sep: str = "|") -> Column:
    """An array as one string, so results compare the same in both engines."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
