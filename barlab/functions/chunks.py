"""Bounded look-back windows over one long series per key, without one task per key.

A key may own a third of all bars. Bars get an exact position (day totals plus
position within the day), the series is cut into chunks of fixed length, and
the last ``halo`` bars of a chunk are also given to the next one. A frame that
looks back at most ``halo`` rows then sees exactly the rows it would see in the
uncut series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 8192


def with_position(bars: DataFrame, key: str = "symbol", day: str = "d", ts: str = "ts") -> DataFrame:
    """Add ``pos``, the zero-based position of a bar in the series of its key."""
    per_day = bars.groupBy(key, day).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    start = per_day.select(key, day, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_day = F.row_number().over(Window.partitionBy(key, day).orderBy(ts)) - 1
    return (
        bars.join(start, [key, day])
        .withColumn("bar_index", in_day)
        .withColumn("pos", F.col("_start") + F.col("bar_index"))
        .drop("_start")
    )


def with_previous(bars: DataFrame, value: str, name: str, key: str = "symbol", day: str = "d", ts: str = "ts") -> DataFrame:
    """Add the value of the bar before, across days, with windows no longer than a day.

    The first bar of a day takes the last value of the key's previous day from
    a table with one row per key and day.
    """
    ends = bars.groupBy(key, day).agg(F.max_by(value, ts).alias("_end"))
    before = ends.select(key, day, F.lag("_end").over(Window.partitionBy(key).orderBy(day)).alias("_before"))
    w = Window.partitionBy(key, day).orderBy(ts)
    joined = bars.join(before, [key, day])
    first = F.row_number().over(w) == 1
    return joined.withColumn(name, F.when(first, F.col("_before")).otherwise(F.lag(value).over(w))).drop("_before")


def with_chunks(positioned: DataFrame, halo: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk`` and ``own``; halo copies have ``own`` false."""
    if halo >= chunk_rows:
        raise ValueError("the halo must be shorter than a chunk")
    home = F.floor(F.col("pos") / chunk_rows)
    spill = F.col("pos") % chunk_rows >= chunk_rows - halo
    return (
        positioned.withColumn("_home", home)
        .withColumn("chunk", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn("own", F.col("chunk") == F.col("_home"))
        .drop("_home")
    )


def chunk_window(key: str = "symbol") -> WindowSpec:
    return Window.partitionBy(key, "chunk").orderBy("pos")


def owned(df: DataFrame) -> DataFrame:
    return df.where("own").drop("own", "chunk")
