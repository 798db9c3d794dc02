"""Entry geometry: volatility of the continuous series, fractal levels and their breaks.

Level logic runs as windows over (symbol, d): the newest confirmed pivot is a
forward fill, and a level fires at the first qualifying bar of its stretch.
Sessions are bounded by the trading day, so those windows are small; only the
look-back measures cross sessions, and they use chunks with a halo.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.chunks import chunk_window, owned, with_chunks, with_position
from barlab.functions.scalars import hhmm, to_minutes
from barlab.functions.windows import ratio, strict_peak
from barlab.operators.aggregates import percentile_table
from barlab.operators.selection import extremes, hash_sample

# A seed's weight falls by exp(-1) every ``period`` rows; after so many times it is below double precision.
ATR_TIMES = 45


def atr_halo(period: int, back: int) -> int:
    """Rows before a chunk that its smoothed values, its mean ranges and its look-back can depend on."""
    return ATR_TIMES * period + max(period, back) + 1


def indicators(bars: DataFrame, period: int = 14, back: int = 3, chunk_rows: int = 8192) -> DataFrame:
    """True range, Wilder ATR and mean range, plus their values one bar earlier.

    Each chunk is smoothed by its own small task input: the recursion of the
    first chunk is seeded with the mean of its first ``period`` ranges, later
    chunks start in their halo, whose seed has no measurable weight left.
    """
    halo = atr_halo(period, back)
    chunks = with_chunks(with_position(bars), halo, max(chunk_rows, 2 * halo))
    w = chunk_window()
    h, low, prev = F.col("high"), F.col("low"), F.lag("close").over(w)
    span = w.rowsBetween(-(period - 1), 0)
    mean_range = F.when(F.count(F.lit(1)).over(span) == period, F.avg(h - low).over(span))
    frame = chunks.withColumns({
        "tr": F.greatest(h - low, F.abs(h - prev), F.abs(low - prev)),
        "avg_range": mean_range,
        "low_back": F.lag("low", back).over(w),
        "high_back": F.lag("high", back).over(w),
    })
    frame = frame.withColumn("avg_range_prev", F.lag("avg_range").over(w))
    frame = frame.withColumns({"atr": F.lit(None).cast("double"), "atr_prev": F.lit(None).cast("double")})

    def smooth(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("pos")
        tr = rows["tr"]
        start = 0
        if rows["pos"].iloc[0] == 0:
            start = period - 1
            if len(tr) > start:
                tr = tr.copy()
                tr.iloc[start] = tr.iloc[:period].mean()
        atr = tr.iloc[start:].ewm(alpha=1 / period, adjust=False).mean().reindex(tr.index)
        rows["atr"] = atr
        rows["atr_prev"] = atr.shift(1)
        return rows[rows["own"]]

    return owned(frame.groupBy("symbol", "chunk").applyInPandas(smooth, frame.schema))


def _session() -> Window:
    return Window.partitionBy("symbol", "d").orderBy("bar_index")


def _pivot(kind: str) -> Column:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    color = F.when(F.col("close") >= F.col("open"), "green").otherwise("red")
    extreme, wick, body = (top, "high", bottom) if kind == "high" else (bottom, "low", top)
    return F.struct(
        F.lit(kind).alias("type"), F.col("bar_index").alias("j"), F.col("ts").alias("pivot_ts"), F.col("t").alias("pivot_t"),
        color.alias("color"), extreme.alias("body_extreme"), F.col(wick).alias("wick"), body.alias("body_stop"),
    )


def with_pivots(bars: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Mark strict fractal highs and lows for each width; needs ``bar_index``."""
    w = _session()
    marks = {}
    for k in widths:
        marks[f"_ph{k}"] = F.when(strict_peak(F.col("high"), k, w), _pivot("high"))
        marks[f"_pl{k}"] = F.when(strict_peak(-F.col("low"), k, w), _pivot("low"))
    return bars.withColumns(marks)


def fractal_pivots(bars: DataFrame, k: int) -> DataFrame:
    """One row per pivot, with the bar at which it becomes known."""
    marked = with_pivots(bars, [k])
    both = F.array_compact(F.array(f"_ph{k}", f"_pl{k}"))
    return marked.select("symbol", "d", F.explode(both).alias("p")).select(
        "symbol", "d", "p.*", (F.col("p.j") + k).alias("confirm_j")
    )


def triggers(measured: DataFrame, widths: Sequence[int], window_start: str, window_end: str) -> DataFrame:
    """Level breaks with their measures, for every fractal width in one pass.

    ``measured`` comes from :func:`indicators`. A pivot replaces its side's
    level when confirmed, before the break test of that bar. A break outside
    the entry window leaves the level alive.
    """
    w = _session()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = with_pivots(measured, widths).withColumn("open_0915", F.min_by("open", "bar_index").over(Window.partitionBy("symbol", "d")))
    df = df.withColumns({f"_{s}{k}": F.lag(f"_p{s}{k}", k).over(w) for k in widths for s in "hl"})
    df = df.withColumns({f"_{s}{k}": F.last(f"_{s}{k}", ignorenulls=True).over(upto) for k in widths for s in "hl"})
    df = df.withColumns({f"_{s}j{k}": F.col(f"_{s}{k}.j") for k in widths for s in "hl"})
    inside = F.col("t").between(to_minutes(window_start), to_minutes(window_end))
    fired, first = [], {}
    for k in widths:
        high, low = F.col(f"_h{k}"), F.col(f"_l{k}")
        for side, broke, level, guard in (
            ("long", F.col("close") > high["body_extreme"], high, low), ("short", F.col("close") < low["body_extreme"], low, high),
        ):
            hit = inside & broke
            stretch = Window.partitionBy("symbol", "d", f"_{'h' if side == 'long' else 'l'}j{k}")
            name = f"_first_{side}{k}"
            first[name] = F.min(F.when(hit, F.col("bar_index"))).over(stretch)
            fired.append(F.when(hit & (F.col("bar_index") == F.col(name)), _trigger(side, k, level, guard)))
    df = df.withColumns(first)
    out = df.select("symbol", F.col("d").alias("date"), F.explode(F.array_compact(F.array(*fired))).alias("g"))
    return out.select("symbol", "date", "g.*")


def _trigger(direction: str, k: int, level: Column, guard: Column) -> Column:
    entry, span = F.col("close"), F.col("high") - F.col("low")
    third, own = (F.col("low_back"), F.col("low")) if direction == "long" else (F.col("high_back"), F.col("high"))

    def distance(stop: Column) -> Column:
        return ratio(F.abs(entry - stop), entry)

    return F.struct(
        F.lit(k).alias("k"), F.lit(direction).alias("direction"), F.col("bar_index").alias("bar_index"), F.col("t").alias("trigger_t"),
        hhmm(F.col("t")).alias("trigger_time"),
        F.when(entry > F.col("open_0915"), "above").otherwise("below").alias("pos_vs_open"), F.col("open_0915").alias("open_0915"),
        level["body_extreme"].alias("level_price"), hhmm(level["pivot_t"]).alias("swing_candle_time"),
        level["color"].alias("swing_candle_color"), (F.col("bar_index") - level["j"] - k).alias("bars_since_swing"),
        F.col("open").alias("bo_open"), F.col("high").alias("bo_high"), F.col("low").alias("bo_low"), F.col("close").alias("bo_close"),
        span.alias("bo_range"), entry.alias("entry_price"), F.col("atr_prev").alias("atr_at_entry"),
        F.col("avg_range_prev").alias("avg_range_at_entry"), ratio(span, F.col("atr_prev")).alias("atr_ratio"),
        ratio(span, F.col("avg_range_prev")).alias("range_ratio"),
        guard["wick"].alias("swing_stop_price_wick"), guard["body_stop"].alias("swing_stop_price_body"),
        third.alias("third_back_stop_price"), own.alias("bo_candle_stop_price"),
        distance(guard["wick"]).alias("stop_dist_swing_wick_pct"), distance(guard["body_stop"]).alias("stop_dist_swing_body_pct"),
        distance(third).alias("stop_dist_thirdback_pct"), distance(own).alias("stop_dist_bocandle_pct"),
    )


def locked_basket(long: DataFrame, checkpoint: str, size: int) -> DataFrame:
    """The leaders at one checkpoint of each day."""
    from barlab.operators.rvol import ranked_top

    return ranked_top(long.where(F.col("checkpoint") == checkpoint), size).select("date", "symbol", "r_rank")


def rolling_basket(long: DataFrame, checkpoints: Sequence[str], size: int) -> DataFrame:
    """The leaders at each of several checkpoints."""
    from barlab.operators.rvol import ranked_top

    at = long.where(F.col("checkpoint").isin(list(checkpoints)))
    return ranked_top(at, size).select("date", "checkpoint", "symbol", F.col("r_rank").alias("rank_at_cp"))


def basket_triggers(found: DataFrame, basket: DataFrame) -> DataFrame:
    """Triggers on basket members of the day, with their rank."""
    return found.join(basket.select("date", "symbol", "r_rank"), ["date", "symbol"])


# distributions

HUGE_METRICS = ("atr_ratio", "range_ratio")
STOP_METRICS = ("stop_dist_swing_wick_pct", "stop_dist_swing_body_pct", "stop_dist_thirdback_pct", "stop_dist_bocandle_pct")
PERCENTS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def trigger_distributions(found: DataFrame) -> DataFrame:
    return percentile_table(found, [*HUGE_METRICS, *STOP_METRICS], PERCENTS)


def huge_readoff(found: DataFrame) -> DataFrame:
    """Quantiles of the bar-size ratios and the share above 1, 1.5 and 2."""
    table = percentile_table(found, list(HUGE_METRICS), (0.5, 0.75, 0.9, 0.95)).withColumnRenamed("p50", "median")
    long = found.select(*HUGE_METRICS).unpivot([], list(HUGE_METRICS), "metric", "v").where(F.col("v").isNotNull())
    over = long.groupBy("metric").agg(*[
        F.avg((F.col("v") > x).cast("double")).alias(name)
        for name, x in (("pct_over_1x", 1.0), ("pct_over_1_5x", 1.5), ("pct_over_2x", 2.0))
    ])
    return table.drop("n", "mean", "std").join(over, "metric")


def trigger_sanity(found: DataFrame, test_days: Column) -> DataFrame:
    """Counts per day, per side and per position against the open, in one row."""
    per_day = found.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") == "long").alias("l"),
        *[
            F.count_if((F.col("direction") == d) & (F.col("pos_vs_open") == p)).alias(f"{d}_{p}")
            for d in ("long", "short") for p in ("above", "below")
        ],
    )
    out = per_day.agg(
        F.sum("n").alias("n_triggers"), F.avg("n").alias("per_day_mean"), F.median("n").alias("per_day_median"),
        F.max("n").alias("per_day_max"), F.count(F.lit(1)).alias("days_with_trigger"), F.sum("l").alias("long"),
        (F.sum("n") - F.sum("l")).alias("short"),
        *[F.sum(f"{d}_{p}").alias(f"{d}_{p}") for d in ("long", "short") for p in ("above", "below")],
    ).withColumn("n_test_days", test_days)
    return out.withColumn("pct_days_with_trigger", F.col("days_with_trigger") / F.col("n_test_days") * 100)


def audit_sample(found: DataFrame, n_extreme: int, n_random: int, seed: int = 7) -> DataFrame:
    """The largest bars by ATR ratio, and a repeatable sample of the others."""
    key = ["date", "symbol", "direction", "trigger_t"]
    rated = found.where(F.col("atr_ratio").isNotNull())
    top = extremes(rated, [F.desc("atr_ratio"), *[F.col(c) for c in key]], n_extreme)
    rest = rated.join(top.select(*key), key, "left_anti")
    return top.withColumn("audit_bucket", F.lit("extreme_huge")).unionByName(
        hash_sample(rest, n_random, key, seed).withColumn("audit_bucket", F.lit("random_normal"))
    )
