"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    return ts.cast("date")


def clock(ts: Column) -> Column:
    """Wall-clock time as HH:mm; its text order is its time order."""
    return F.concat_ws(":", F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lpad(F.minute(ts).cast("string"), 2, "0"))


def minutes(ts: Column) -> Column:
    """Minutes since midnight: an int, so aggregates keyed on it stay hash based."""
    return F.hour(ts) * 60 + F.minute(ts)


def to_minutes(hhmm: str) -> int:
    hour, minute = hhmm.split(":")
    return int(hour) * 60 + int(minute)


def hhmm(m: Column) -> Column:
    """Minutes since midnight back to HH:mm."""
    return F.concat_ws(
        ":",
        F.lpad(F.floor(m / 60).cast("string"), 2, "0"),
        F.lpad((m % 60).cast("string"), 2, "0"),
    )


def label(checkpoint: str) -> str:
    return checkpoint.replace(":", "")


def finite(x: Column) -> Column:
    """Infinite and NaN values become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def banded(x: Column, bands: Sequence[tuple[str, float, float]], default: str = "unknown") -> Column:
    """Name of the [lower, upper) band holding ``x``; a later band overrides an earlier one."""
    out = None
    for name, lower, upper in reversed(list(bands)):
        inside = (x >= lower) & (x < upper)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(default)


def bucket_index(x: Column, edges: Sequence[float], when_null: float = 0.5) -> Column:
    """Number of edges at or below ``x``."""
    value = F.coalesce(x, F.lit(when_null))
    total = F.lit(0)
    for edge in edges:
        total = total + (value >= edge).cast("int")
    return total


def direction_case(up: Column, down: Column) -> Column:
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return F.when(up & down, "both").when(up, "up").when(down, "down").otherwise("none")


def chart_symbol(symbol: Column, exchange: str = "NSE") -> Column:
    return F.concat(F.lit(f"{exchange}:"), F.translate(symbol, "&-", "__"))


def percent(x: Column, digits: int = 2) -> Column:
    return F.round(x * 100, digits)


def percent_half_even(x: Column, digits: int = 2) -> Column:
    """Rounds half to even, which tables made with pandas need."""
    return F.bround(x * 100, digits)


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def last_weekday_of_month(d: Column, weekday: int) -> Column:
    """Last date of the month of ``d`` that falls on ``weekday`` (Monday is 0)."""
    end = F.last_day(d)
    return F.date_sub(end, (F.weekday(end) - weekday + 7) % 7)


def share(condition: Column) -> Column:
    """Mean of a condition, nulls counted as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))
