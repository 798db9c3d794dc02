"""Expanding ranks over keys of any size, from two-dimensional dominance counts.

The rank of a row's value among all rows up to it counts the earlier rows with
a smaller value. A key with more than ``ROWS`` rows is cut both in time (chunks)
and by value (ranges), at points from one bounded sketch. The rows that a given
row has to count then fall into three parts:

* earlier chunks and lower ranges: prefix sums over the table of counts per
  (chunk, range), which has at most as many rows as there are cells;
* the same chunk and lower ranges: the chunk alone shows them;
* the same range: the range alone shows them.

So no task ever holds a whole key, only one chunk or one range of it. A value
that fills a cut by itself is a range of its own; its rows are all equal and are
counted from the table and the chunk, so heavy ties do not build a large range.
A key of at most ``ROWS`` rows is ranked in one piece.

Key, order and value are written once, so that finding the large keys does not
compute the input again. The rows of large keys are written with their cells
before the counts are taken: a sketch need not give the same cuts twice, and
all three parts must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scans import as_number
from barlab.session import materialise

#: Rows of a key that one task takes whole; larger keys are cut into at most CUTS parts each way.
ROWS = 16_384
CUTS = 256


def earlier_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, how many earlier values are smaller and how many are equal.

    Goes through the bits of the dense ranks from the top: rows that share all
    higher bits form a block in time order, and a row with a one has the zeros
    ahead of it in its block below it. That is n log n without a loop over rows.
    """
    n = len(values)
    less, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return less, equal
    codes = np.unique(values, return_inverse=True)[1].reshape(-1)
    steps = np.arange(n)

    def block_start(blocks: np.ndarray) -> np.ndarray:
        first = np.ones(n, bool)
        first[1:] = blocks[1:] != blocks[:-1]
        return np.maximum.accumulate(np.where(first, steps, 0))

    at = steps
    for bit in reversed(range(int(codes.max()).bit_length())):
        now = codes[at]
        one = (now >> bit) & 1
        ahead = np.cumsum(1 - one) - (1 - one)
        less[at] += np.where(one == 1, ahead - ahead[block_start(now >> (bit + 1))], 0)
        at = at[np.argsort(now >> bit, kind="stable")]
    equal[at] = steps - block_start(codes[at])
    return less, equal


def _place(cuts: str, value: str) -> Column:
    """Twice the number of cuts below, one more on a cut."""
    below = F.size(F.filter(cuts, lambda c: c < F.col(value)))
    return below * 2 + F.array_contains(cuts, F.col(value)).cast("int")


def _narrow(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Key, order, value and the order as a number; NaN counts as missing, as it does in a rank of a numeric series."""
    v = F.col(value).cast("double")
    return df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.when(~F.isnan(v), v).alias("v"), as_number(df, order).alias("t"))


def _ranged(large: DataFrame) -> DataFrame:
    """The rows of large keys with their chunk ``i`` and range ``j``."""
    grid = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    every = F.ceil(F.lit(CUTS * ROWS) / F.col("n"))

    def sketched(column: str) -> Column:
        return F.percentile_approx(column, grid, F.lit(8 * CUTS))

    def kept(column: str) -> Column:
        found = F.coalesce(column, F.array().cast("array<double>"))
        return F.array_distinct(F.filter(found, lambda x, at: (at + 1) % every == 0))

    sizes = large.groupBy("k").agg(F.count(F.lit(1)).alias("n"), sketched("t").alias("ts"), sketched("v").alias("vs"))
    joined = _null_safe(large, sizes.select("k", kept("ts").alias("ts"), kept("vs").alias("vs")), ["k"])
    i = F.floor((_place("ts", "t") + 1) / 2).cast("int")  # a chunk begins at its lower cut
    return materialise(joined.select("k", "o", "v", "t", i.alias("i"), _place("vs", "v").alias("j")), "cells")


def _before(large: DataFrame) -> DataFrame:
    """Per cell: rows in earlier chunks and lower ranges, in earlier chunks and this range, in earlier chunks at all; and the order of the next chunk's first row."""
    cells = large.where("v is not null").groupBy("k", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    chunks = large.groupBy("k", "i").agg(F.min("o").alias("first"), F.count("v").alias("held"))
    by_chunk = Window.partitionBy("k").orderBy("i")
    chunks = chunks.select(
        "k", "i", F.lead("first").over(by_chunk).alias("next_first"),
        F.coalesce(F.sum("held").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("all_before"),
    )
    # every chunk meets every range of its key, so that counts add up over chunks
    ranges = cells.select("k", "j").distinct()
    grid = _null_safe(chunks, ranges, ["k"])
    grid = _null_safe(grid, cells, ["k", "i", "j"]).withColumn("n", F.coalesce("n", F.lit(0)))
    column = Window.partitionBy("k", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("same", F.coalesce(F.sum("n").over(column), F.lit(0)))
    row = Window.partitionBy("k", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("lower", F.coalesce(F.sum("same").over(row), F.lit(0))).drop("n")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(named, met, "left").drop(*[f"_r_{c}" for c in on])


def expanding_ranks(df: DataFrame, value: str, min_rows: int, name: str, key: str = "symbol", order: str = "date") -> DataFrame:
    """Average-rank percentile of the previous value within the history up to it, as (key, order, name).

    ``order`` is unique within a key. Every row has one here; with a missing
    previous value, or fewer than ``min_rows`` values up to it, it is null.
    """
    narrow = materialise(_narrow(df, key, order, value), "ranked")
    kinds = dict(narrow.dtypes)
    of_key = materialise(narrow.groupBy("k").count().where(F.col("count") > ROWS).select("k"), "large-keys")
    if of_key.isEmpty():
        out = _short(narrow, kinds, min_rows)
    else:
        there = F.col("k").eqNullSafe(F.col("_r_k"))
        named = of_key.select(F.col("k").alias("_r_k"))
        out = _short(narrow.join(named, there, "left_anti"), kinds, min_rows).unionByName(
            _long(narrow.join(named, there, "left_semi"), kinds, min_rows)
        )
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.when(~F.isnan("r"), F.col("r")).alias(name))


def _rank(less: np.ndarray, equal: np.ndarray, upto: np.ndarray, there: np.ndarray, min_rows: int) -> np.ndarray:
    return np.where(there & (upto >= min_rows), (less + (equal + 2) / 2) / np.maximum(upto, 1), np.nan)


def _short(narrow: DataFrame, kinds: dict[str, str], min_rows: int) -> DataFrame:
    """Keys of at most ROWS rows, each in one piece; a row's rank goes to the row after it."""

    def ranks(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("o")
        there = group["v"].notna().to_numpy()
        less, equal = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        less[there], equal[there] = earlier_counts(group["v"].to_numpy()[there])
        rank = _rank(less, equal, np.cumsum(there), there, min_rows)
        return pd.DataFrame({"k": group["k"], "o": group["o"], "r": np.concatenate([[np.nan], rank[:-1]])})

    return narrow.select("k", "o", "v").groupBy("k").applyInPandas(ranks, f"k {kinds['k']}, o {kinds['o']}, r double")


def _long(narrow: DataFrame, kinds: dict[str, str], min_rows: int) -> DataFrame:
    ranged = _ranged(narrow)
    schema = f"k {kinds['k']}, o {kinds['o']}, next_o {kinds['o']}, less long, equal long, upto long, held int"

    def in_range(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of one range."""
        group = group.sort_values("o")
        less, equal = earlier_counts(group["v"].to_numpy())
        return pd.DataFrame({"k": group["k"], "o": group["o"], "next_o": None, "less": less, "equal": equal, "upto": 0, "held": 0})

    def in_chunk(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of one chunk: lower ranges of the chunk, and what the table has of earlier chunks."""
        group = group.sort_values("o")
        there = group["v"].notna().to_numpy()
        ranges = group["j"].to_numpy()[there].astype(np.int64)
        lower, cell = earlier_counts(ranges)
        less, equal = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        less[there] = lower + group["lower"].to_numpy()[there].astype(np.int64)
        # rows on a cut are all equal and are left out of the ranges
        equal[there] = np.where(ranges % 2 == 1, cell + group["same"].to_numpy()[there].astype(np.int64), 0)
        after = group["o"].shift(-1)
        after.iloc[-1] = group["next_first"].iloc[-1]
        upto = np.cumsum(there) + int(group["all_before"].iloc[0])
        return pd.DataFrame({"k": group["k"], "o": group["o"], "next_o": after, "less": less, "equal": equal, "upto": upto, "held": there.astype("int32")})

    from_ranges = ranged.where("v is not null and j % 2 = 0").select("k", "o", "v", "j").groupBy("k", "j").applyInPandas(in_range, schema)
    table = materialise(_before(ranged), "cell-counts")
    chunk_rows = _null_safe(ranged, table.where("j is not null").select("k", "i", "j", "lower", "same"), ["k", "i", "j"])
    per_chunk = table.groupBy("k", "i").agg(F.max("next_first").alias("next_first"), F.max("all_before").alias("all_before"))
    chunk_rows = _null_safe(chunk_rows, per_chunk, ["k", "i"]).select("k", "o", "v", "i", "j", "lower", "same", "next_first", "all_before")
    from_chunks = chunk_rows.groupBy("k", "i").applyInPandas(in_chunk, schema)
    # every row has a part from its chunk, most have one from their range
    counted = from_ranges.unionByName(from_chunks).groupBy("k", "o").agg(
        F.max("next_o").alias("next_o"), F.sum("less").alias("less"), F.sum("equal").alias("equal"), F.max("upto").alias("upto"), F.max("held").alias("held")
    )
    rank = F.when((F.col("held") == 1) & (F.col("upto") >= min_rows), (F.col("less") + (F.col("equal") + 2) / 2) / F.col("upto"))
    first = narrow.groupBy("k").agg(F.min("o").alias("o")).withColumn("r", F.lit(None).cast("double"))
    return counted.where("next_o is not null").select("k", F.col("next_o").alias("o"), rank.alias("r")).unionByName(first)
