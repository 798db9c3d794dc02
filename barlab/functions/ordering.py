"""Ranks, running totals and exact percentiles over groups of any size.

Percentiles are selected between brackets. For the others a plain ordered window keeps a whole group in one task. These helpers cut each
group into value ranges first (split points from a bounded sketch), so even a
group that holds most of the table is spread: totals per range are summed over
a table of at most ``2 * parts + 1`` rows per group, and the ordered window
only ever runs inside one range. A value that is itself a split point gets a
range of its own, so heavy ties do not blow up their neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64
#: Shares that the rows of a group are dealt into where they meet a row of their group.
SHARES = 32


def with_ranges(df: DataFrame, keys: Sequence[str], order: Column, parts: int = PARTS) -> DataFrame:
    """Add ``_v`` (the order value) and ``_part`` (its range within the group)."""
    keys = list(keys)
    work = df.withColumn("_v", order.cast("double"))
    grid = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = work.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", grid, F.lit(10 * parts))).alias("_cuts"))
    if keys:
        work = _attach_group(work, cuts, keys)
    else:
        work = work.withColumn("_cuts", cuts.scalar())
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    on_cut = F.array_contains("_cuts", F.col("_v"))
    return work.withColumn("_part", F.coalesce(below * 2 + on_cut.cast("int"), F.lit(-1))).drop("_cuts")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    sums: dict[str, Column],
    parts: int = PARTS,
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` in rising ``order``, with the group's ``<name>_total`` on request.

    ``order`` must be unique within a group; collapse equal values first.
    """
    keys = list(keys)
    ranged = with_ranges(df, keys, order, parts)
    for name, expr in sums.items():
        ranged = ranged.withColumn(f"_s_{name}", expr)
    return _offset_sums(ranged, keys, list(sums), [F.col("_v")], totals).drop("_part", "_v")


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    tie: Column,
    name: str = "row_number",
    parts: int = PARTS,
) -> DataFrame:
    """One-based position in rising ``order``; equal values go by the number ``tie``.

    Rows that share one heavy value form a range of their own, which is cut
    again by ``tie``.
    """
    keys = list(keys)
    first = with_ranges(df, keys, order, parts).withColumnsRenamed({"_v": "_v1", "_part": "_part1"})
    heavy = F.when(F.col("_part1") % 2 == 1, tie.cast("double")).otherwise(F.lit(0.0))
    second = with_ranges(first, [*keys, "_part1"], heavy, parts)
    ranged = (
        second.withColumn("_part", F.struct("_part1", "_part"))
        .withColumn("_tie", tie)
        .withColumn(f"_s_{name}", F.lit(1))
    )
    out = _offset_sums(ranged, keys, [name], [F.col("_v1"), F.col("_tie")])
    return out.drop("_part", "_part1", "_v", "_v1", "_tie")


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys where null equals null."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


def _attach_group(left: DataFrame, right: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Join of rows with one row a group, by which no group's rows come into one task.

    The rows are dealt by group and by the partition they come from, and the
    group's row is repeated for each share. ``few`` says that the number of
    groups is bounded; then the groups go to every task and no row moves.
    """
    if few:
        return _attach(left, F.broadcast(right), keys)
    dealt = left.withColumn("_share", F.spark_partition_id() % SHARES)
    repeated = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return _attach(dealt, repeated, [*keys, "_share"]).drop("_share")


def _offset_sums(ranged: DataFrame, keys: list[str], names: list[str], order: list[Column], totals: bool = False) -> DataFrame:
    per_range = ranged.groupBy(*keys, "_part").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    whole = [F.sum(f"_t_{n}").over(group).alias(f"{n}_total") for n in names if totals]
    offsets = per_range.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names], *whole
    )
    joined = _attach(ranged, offsets, [*keys, "_part"])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in names:
        joined = joined.withColumn(n, F.col(f"_o_{n}") + F.sum(f"_s_{n}").over(inside))
    helper = [c for c in joined.columns if c.startswith(("_s_", "_o_"))]
    return joined.drop(*helper)


#: Accuracy of the sketch with and without keys, and how many of its steps a bracket leaves on both sides of a rank.
ACCURACY, ACCURACY_ALL, MARGIN = 5_000, 100_000, 10


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int | None = None,
                      few: bool = False) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per entry of ``probs``.

    Equals ``percentile``, by selection: a sketch of bounded size brackets each
    wanted rank, one pass counts the rows between the brackets and the distinct
    values inside them, and only those values are ordered. The input is read
    twice. A bracket holds ``2 * MARGIN / accuracy`` of a group's rows, so the
    ordered window runs over a fraction of it. Nulls are left out; a group of
    nulls only has none. Should a wanted rank lie outside its bracket, which
    the margin makes all but impossible, the query fails instead of guessing.
    ``few`` says that the number of groups is bounded.
    """
    keys = list(keys)
    accuracy = accuracy or (ACCURACY if keys else ACCURACY_ALL)
    reach = MARGIN / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    low = F.array(*[F.lit(max(0.0, float(p) - reach)) for p in probs.values()])
    high = F.array(*[F.lit(min(1.0, float(p) + reach)) for p in probs.values()])
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_x", low, F.lit(accuracy)).alias("_low"), F.percentile_approx("_x", high, F.lit(accuracy)).alias("_high")
    )
    if keys:
        bound = _attach_group(rows, sketch, keys, few)
    else:
        bound = rows.withColumn("_b", sketch.select(F.struct("_low", "_high")).scalar()).select("_x", "_b._low", "_b._high")
    inside = F.exists(F.arrays_zip("_low", "_high"), lambda b: (b["_low"] <= F.col("_x")) & (F.col("_x") <= b["_high"]))
    # rows between brackets fall together; their number, smallest and largest value are enough
    gap = F.size(F.filter("_low", lambda c: c <= F.col("_x")))
    cell = F.when(inside, F.col("_x"))
    counted = bound.groupBy(*keys, cell.alias("_v"), F.when(~inside, gap).alias("_gap")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max")
    )
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    upto = F.sum("_n").over(group.orderBy("_min").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_total": F.sum("_n").over(group)})

    def at(rank: Column) -> Column:
        """The value of a one-based rank."""
        here = (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
        known = (
            F.when(F.col("_min") == F.col("_max"), F.col("_min"))
            .when(rank == F.col("_upto") - F.col("_n") + 1, F.col("_min")).when(rank == F.col("_upto"), F.col("_max"))
            .otherwise(F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double"))
        )
        return F.max(F.when(here, known))

    aggs = []
    for name, p in probs.items():
        position = (F.col("_total") - 1) * F.lit(float(p))  # zero-based, fractional
        first, second = at(F.floor(position) + 1), at(F.ceil(position) + 1)
        aggs.append((first + (second - first) * F.max(position - F.floor(position))).alias(name))
    return placed.groupBy(*keys).agg(*aggs)
