"""Set operations, reshaping and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scans import Scan, as_number

def labelled_union(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Stack frames with a constant label per source."""
    out = None
    for label, df in parts.items():
        tagged = df.withColumn(name, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def overlap_with_next(picks: DataFrame, keys: Sequence[str], item: str, step: str) -> DataFrame:
    """Share of each step's items that are still there at the next step.

    A lead over the steps of one item replaces the self-join: an item is kept
    when its next listed step is the following one. Needs numbered steps.
    """
    w = Window.partitionBy(*keys, item).orderBy(step)
    kept = F.coalesce(F.lead(step).over(w) == F.col(step) + 1, F.lit(False))
    return (
        picks.select(*keys, item, step).distinct().withColumn("_kept", kept)
        .groupBy(*keys, step).agg(F.avg(F.col("_kept").cast("double")).alias("persistence"))
    )


def to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def to_wide(long: DataFrame, keys: Sequence[str], metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(metric, list(metrics)).agg(F.first(value))


def longest_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Length of the longest unbroken run of ``condition``, for keys of any size.

    The distance to the last row that broke the run is the run length: a scan
    that numbers the rows, and one that carries the last broken number.
    """
    held = F.coalesce(condition, F.lit(False))
    scan = Scan(df.withColumn("_c", held), keys, as_number(df, order[0]), order[1:])
    scan.add(_i=("sum", F.lit(1))).add(_broken=("last", F.when(~F.col("_c"), F.col("_i"))))
    run = F.col("_i") - F.coalesce("_broken", F.lit(0))
    return scan.result().groupBy(*keys).agg(F.max(run).alias("longest_streak"))


def drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: str) -> DataFrame:
    """Running total, its running peak and the distance below it, for keys of any size."""
    scan = Scan(df, keys, as_number(df, order[0]), order[1:])
    out = scan.add(equity=("sum", F.col(step))).add(peak=("max", F.col("equity"))).result()
    return out.withColumn("drawdown", F.col("peak") - F.col("equity"))
