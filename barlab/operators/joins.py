"""Join shapes the analyses rely on.

No side is force-broadcast unless its rows are bounded by the calendar (one
per date) or by a literal list; everything else is left to the size checks of
adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_first(bars: DataFrame, keys: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """Give every bar the first ``value`` of its group: one shuffle, no self-join."""
    return bars.withColumn(name, F.min_by(value, order).over(Window.partitionBy(*keys)))


def through_membership(bars: DataFrame, members: DataFrame, bench: DataFrame, value: str) -> DataFrame:
    """Bars paired with each of their benchmarks at the same time; never forward-filled."""
    other = bench.select("benchmark_index", "ts", F.col(value).alias(f"bench_{value}"))
    return bars.join(members, "symbol").join(other, ["benchmark_index", "ts"])


def attach_by_date(panel: DataFrame, by_date: DataFrame, day: str = "date") -> DataFrame:
    """A row per date onto every symbol; whether the date table is broadcast is left to its measured size."""
    return panel.join(by_date, day, "left")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match in ``right``, as count and share."""
    hit = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = left.join(hit, list(keys), "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("matched"),
        F.avg(F.col("_hit").isNotNull().cast("double")).alias("share"),
    )


def latest_at_or_before(points: Sequence[int], at: Column) -> Column:
    """The last of a short sorted list of points that is not after ``at``."""
    values = F.array(*[F.lit(p) for p in sorted(points)])
    return F.array_max(F.filter(values, lambda p: p <= at))


def align(calendar: DataFrame, series: DataFrame, day: str = "date") -> DataFrame:
    """The series on another calendar; days it lacks are null."""
    return calendar.select(day).distinct().join(series, day, "left")


def expected_slots(spans: DataFrame, keys: Sequence[str], first: str, last: str, slots: Sequence[int],
                   holidays: DataFrame | None = None) -> DataFrame:
    """Expected (key, d, t): every weekday of the span that is no holiday, times the session slots.

    Days and slots are generated per key from its span row, not joined.
    """
    days = spans.select(*keys, F.explode(F.sequence(first, last)).alias("d")).where(F.weekday("d") < 5)
    if holidays is not None:
        days = days.join(F.broadcast(holidays.select(F.col("date").alias("d")).distinct()), "d", "left_anti")
    return days.select(*keys, "d", F.explode(F.array(*[F.lit(s) for s in slots])).alias("t"))


def exclusive(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Rows only in ``a`` and rows only in ``b``, tagged with their side."""
    only_a = a.join(b.select(*keys), list(keys), "left_anti").withColumn("side", F.lit(names[0]))
    only_b = b.join(a.select(*keys), list(keys), "left_anti").withColumn("side", F.lit(names[1]))
    return only_a.unionByName(only_b)
