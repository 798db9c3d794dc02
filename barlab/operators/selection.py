"""Top rows per group, extremes and repeatable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their rank.

    A limit on ``row_number`` is pushed below the shuffle, so each task sends
    at most ``n`` rows per group, however large the group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def first_per_day(df: DataFrame, order: Sequence[Column], day: str = "date") -> DataFrame:
    return top_per_group(df, [day], order, 1, "_first").drop("_first")


def extremes(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_dates(df: DataFrame, day: str, n: int) -> DataFrame:
    """The latest ``n`` distinct dates."""
    return df.select(day).distinct().orderBy(F.desc(day)).limit(n)


def stratified_sample(df: DataFrame, stratum: str, per_stratum: int, key: Sequence[str], seed: int) -> DataFrame:
    """Up to ``per_stratum`` rows per stratum, chosen by a hash of the row key.

    The same rows come back on every run and on any partitioning.
    """
    order = F.xxhash64(*key, F.lit(seed))
    return top_per_group(df, [stratum], [order, *[F.col(k) for k in key]], per_stratum, "_pick").drop("_pick")


def hash_sample(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def best_by(df: DataFrame, metric: str, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """The item with the largest metric; equal metrics go to the smallest item."""
    rank = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(F.desc_nulls_last(metric), item)
    return df.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def nulls_last(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Case-insensitive order of text, natural order otherwise, nulls at the end."""
    c = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last())
