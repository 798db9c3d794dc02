"""Group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.ordering import exact_percentiles, with_running
from barlab.functions.scalars import label, to_minutes
from barlab.functions.scans import Scan
from barlab.functions.windows import nonzero


def session_edges(bars: DataFrame, keys: Sequence[str] = ("symbol", "d"), order: str = "t") -> DataFrame:
    """First open and last close; a fixed-width ``order`` keeps the aggregate hash based."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", order).alias("session_open"), F.max_by("close", order).alias("session_close")
    )


def checkpoint_columns(checkpoints: Sequence[str], t: Column | None = None) -> list[Column]:
    """Per checkpoint: cumulative volume and price up to it, high and low after it."""
    t = F.col("t") if t is None else t
    out = []
    for cp in checkpoints:
        upto, m = t <= to_minutes(cp), label(cp)
        out += [
            F.sum(F.when(upto, F.col("volume"))).alias(f"cv_{m}"),
            F.max_by(F.when(upto, F.col("close")), F.when(upto, t)).alias(f"px_{m}"),
            F.max(F.when(~upto, F.col("high"))).alias(f"hi_after_{m}"),
            F.min(F.when(~upto, F.col("low"))).alias(f"lo_after_{m}"),
        ]
    return out


def conditional_extremes(df: DataFrame, keys: Sequence[str], value: str, checkpoints: Sequence[str]) -> DataFrame:
    """Min, max and mean of ``value`` over the rows up to each checkpoint."""
    out = []
    for cp in checkpoints:
        x = F.when(F.col("t") <= to_minutes(cp), F.col(value))
        out += [F.min(x).alias(f"min_{label(cp)}"), F.max(x).alias(f"max_{label(cp)}"), F.avg(x).alias(f"avg_{label(cp)}")]
    return df.groupBy(*keys).agg(*out)


def describe_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, deviation and extremes per key, for keys of any size."""
    moments = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"),
    )
    return moments.join(exact_percentiles(df, keys, value, {"median": 0.5}), list(keys), "left")


def describe_all(df: DataFrame, value: str) -> DataFrame:
    """Overall count, mean, deviation, extremes and quartiles."""
    moments = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = exact_percentiles(df, [], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.withColumn("_q", quartiles.select(F.struct("p25", "p50", "p75")).scalar()).select(
        "n", "mean", "std", "min", "_q.p25", "_q.p50", "_q.p75", "max"
    )


def percentile_set(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], few: bool = False) -> DataFrame:
    """Exact percentiles per group; ``few`` says that the number of groups is bounded."""
    return exact_percentiles(df, keys, value, {f"p{round(p * 100)}": p for p in probs}, few=few)


def percentile_table(df: DataFrame, metrics: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row per metric column: n, mean, deviation and percentiles."""
    long = df.select(*[F.col(m).cast("double") for m in metrics]).unpivot([], list(metrics), "metric", "value")
    moments = long.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return moments.join(percentile_set(long, ["metric"], "value", probs, few=True), "metric", "left")


def shares_over(df: DataFrame, keys: Sequence[str], value: str, thresholds: dict[str, float]) -> DataFrame:
    """Share of rows at or above each threshold."""
    return df.groupBy(*keys).agg(
        *[F.avg((F.col(value) >= t).cast("double")).alias(name) for name, t in thresholds.items()]
    )


def feasibility(df: DataFrame, key: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Counts and percents at or above each threshold per key, and a total row ALL."""
    counts = [F.count_if(F.col(value) >= t).alias(f"ge_{t:g}_count") for t in thresholds]
    grouped = df.rollup(key).agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("days"), *counts)
    out = grouped.withColumn(key, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(key))).drop("_all")
    return out.withColumns(
        {f"ge_{t:g}_pct": F.round(F.col(f"ge_{t:g}_count") / F.col("days") * 100, 1) for t in thresholds}
    )


def vwap(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.groupBy(*keys).agg(
        (F.sum(typical * F.col("volume")) / nonzero(F.sum("volume"))).alias("vwap")
    )


def path_stats(bars: DataFrame) -> DataFrame:
    """Distance travelled bar to bar and deviation of bar returns per session."""
    w = Window.partitionBy("symbol", "d").orderBy("ts")
    prev = F.lag("close").over(w)
    steps = bars.select("symbol", "d", (F.col("close") - prev).alias("step"), ((F.col("close") - prev) / nonzero(prev)).alias("ret"))
    return steps.groupBy("symbol", "d").agg(
        F.sum(F.abs("step")).alias("path_length"), F.stddev_samp("ret").alias("bar_vol")
    )


def mean_of_means(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str) -> DataFrame:
    """Average of the per-``inner`` averages, each inner group counting once."""
    step = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return step.groupBy(*outer).agg(F.avg("_m").alias("mean_of_means"))


def pooled_mean(df: DataFrame, outer: Sequence[str], value: str) -> DataFrame:
    """Average over all rows, each row counting once."""
    return df.groupBy(*outer).agg(F.avg(value).alias("pooled_mean"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Means in a grid; the column values are given, which saves a scan."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def cumulative_share(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Share of the total and running share, largest first; one row per named item, any number of them."""
    total = df.agg(F.sum(value)).scalar()
    shared = df.withColumn("share", F.col(value) / nonzero(total))
    return Scan(shared, [], -F.col(value), [tie]).add(cumulative_share=("sum", F.col("share"))).result()


def value_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, bins: int, clip_quantile: float | None = None) -> DataFrame:
    """Equal-width bin counts; the right tail is clipped to a quantile when asked.

    Bin 0 starts at the minimum, the last bin is closed on the right.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    edges = rows.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    if clip_quantile is not None:
        top = exact_percentiles(rows, [], "_x", {"hi": clip_quantile}).scalar()
        edges = edges.select("lo", top.alias("hi"))
    bound = rows.withColumn("_e", edges.select(F.struct("lo", "hi")).scalar())
    x = F.least(F.col("_x"), F.col("_e.hi"))
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    index = F.when(width == 0, 0).otherwise(F.least(F.floor((x - F.col("_e.lo")) / width), F.lit(bins - 1)))
    return bound.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-frequency bins from interpolated edges, closed on the right; equal edges merge.

    Adds ``bin``, numbered from 1.
    """
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_percentiles(df, [], value, probs).select(
        F.sort_array(F.array_distinct(F.array(*probs))).alias("edges")
    )
    work = df.withColumn("_edges", edges.scalar())
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    above = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return work.withColumn("bin", F.when(F.col(value).isNotNull(), above + 1)).drop("_edges")


def running_total(df: DataFrame, keys: Sequence[str], order: Column, value: str) -> DataFrame:
    """Running total in an order that is unique within the key, for groups of any size."""
    return with_running(df, keys, order, {f"{value}_running": F.col(value)})
