"""Zig-zag swings of a session, as a fold over the session's bars inside the JVM.

One array holds one session of one symbol: at most one bar per slot of the
trading day, so the array is bounded by the session length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SWING = "struct<direction:string,magnitude:double,start_ts:timestamp_ntz,peak_ts:timestamp_ntz,peak_price:double>"
STATE = (
    f"struct<up:boolean,start_ts:timestamp_ntz,start_price:double,hi:double,lo:double,"
    f"peak_ts:timestamp_ntz,done:array<{SWING}>>"
)


def session_arrays(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bars of each session as one time-ordered array."""
    bar = F.struct("ts", F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low"),
                   F.col("close").cast("double").alias("close"))
    return bars.groupBy(*keys).agg(F.array_sort(F.collect_list(bar)).alias("bars"))


def _swing(up: Column, start_ts: Column, start_price: Column, peak_ts: Column, peak: Column) -> Column:
    return F.struct(
        F.when(up, "up").otherwise("down").alias("direction"), F.abs(peak - start_price).alias("magnitude"),
        start_ts.alias("start_ts"), peak_ts.alias("peak_ts"), peak.alias("peak_price"),
    ).cast(SWING)


def swing_array(bars: Column, threshold: Column) -> Column:
    """All swings of a session; a counter-move of ``threshold`` ends one, the open one counts too.

    The direction starts from the first close that differs from the opening
    close; the extreme's bar only moves in the direction of the swing.
    """
    head = F.element_at(bars, 1)
    differs = F.filter(bars, lambda b: b["close"] != head["close"])
    start = F.struct(
        (F.element_at(differs, 1)["close"] > head["close"]).alias("up"),
        head["ts"].alias("start_ts"), head["close"].alias("start_price"), head["high"].alias("hi"), head["low"].alias("lo"),
        head["ts"].alias("peak_ts"), F.array().cast(f"array<{SWING}>").alias("done"),
    ).cast(STATE)

    def step(s: Column, b: Column) -> Column:
        up = s["up"]
        hi, lo = F.greatest(s["hi"], b["high"]), F.least(s["lo"], b["low"])
        moved = (up & (b["high"] > s["hi"])) | (~up & (b["low"] < s["lo"]))
        peak_ts = F.when(moved, b["ts"]).otherwise(s["peak_ts"])
        peak = F.when(up, hi).otherwise(lo)
        turned = F.when(up, hi - b["low"] >= threshold).otherwise(b["high"] - lo >= threshold)
        swing = _swing(up, s["start_ts"], s["start_price"], peak_ts, peak)
        after = F.struct(
            F.when(turned, ~up).otherwise(up).alias("up"),
            F.when(turned, peak_ts).otherwise(s["start_ts"]).alias("start_ts"),
            F.when(turned, peak).otherwise(s["start_price"]).alias("start_price"),
            F.when(turned, b["high"]).otherwise(hi).alias("hi"), F.when(turned, b["low"]).otherwise(lo).alias("lo"),
            F.when(turned, b["ts"]).otherwise(peak_ts).alias("peak_ts"),
            F.when(turned, F.array_append(s["done"], swing)).otherwise(s["done"]).alias("done"),
        )
        return after.cast(STATE)

    def finish(s: Column) -> Column:
        peak = F.when(s["up"], s["hi"]).otherwise(s["lo"])
        return F.array_append(s["done"], _swing(s["up"], s["start_ts"], s["start_price"], s["peak_ts"], peak))

    folded = F.aggregate(F.slice(bars, 2, F.greatest(F.size(bars) - 1, F.lit(0))), start, step, finish)
    none = F.array().cast(f"array<{SWING}>")
    return F.when((F.size(bars) >= 2) & (F.size(differs) > 0), folded).otherwise(none)


def largest_index(swings: Column) -> Column:
    """Zero-based index of the first swing of the greatest magnitude; null without swings."""
    ranked = F.transform(swings, lambda s, i: F.struct(s["magnitude"].alias("m"), (-i).alias("i")))
    return -F.array_max(ranked)["i"]


def false_starts(swings: Column, largest: Column, zone: float) -> Column:
    """Swings before the largest that stayed below the zone and that a later opposite swing exceeds."""
    indexed = F.transform(swings, lambda s, i: F.struct(s["direction"].alias("d"), s["magnitude"].alias("m"), i.alias("i")))
    early = F.filter(
        indexed,
        lambda s: (s["i"] < largest) & (s["m"] < zone)
        & F.exists(indexed, lambda o: (o["i"] > s["i"]) & (o["d"] != s["d"]) & (o["m"] > s["m"])),
    )
    return F.when(F.size(swings) <= 1, 0).otherwise(F.size(early))


def retracement(bars: Column, swing: Column) -> Column:
    """How far price came back from the swing's peak by the end; 0 when at most one bar remains."""
    after = F.filter(bars, lambda b: b["ts"] >= swing["peak_ts"])
    back = F.when(
        swing["direction"] == "up", swing["peak_price"] - F.array_min(F.transform(after, lambda b: b["low"]))
    ).otherwise(F.array_max(F.transform(after, lambda b: b["high"])) - swing["peak_price"])
    return F.when(F.size(after) <= 1, 0.0).otherwise(back)


def session_swings(bars: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """One row per swing with its number in the session."""
    arrays = session_arrays(bars, keys).withColumn("_s", swing_array(F.col("bars"), F.lit(float(threshold))))
    return arrays.select(*keys, F.posexplode("_s").alias("swing_no", "_w")).select(*keys, "swing_no", "_w.*")


def largest_swings(bars: DataFrame, keys: Sequence[str], thresholds: Sequence[float], zone: float) -> DataFrame:
    """Per session and threshold: the largest swing, its retracement and the false starts."""
    arrays = session_arrays(bars, keys)
    grid = arrays.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    grid = grid.withColumn("_s", swing_array(F.col("bars"), F.col("threshold")))
    grid = grid.withColumn("_i", largest_index(F.col("_s")))
    grid = grid.withColumn("_w", F.get("_s", F.col("_i")))
    w = F.col("_w")
    return grid.select(
        *keys, "threshold", w["direction"].alias("direction"), w["magnitude"].alias("magnitude"),
        w["start_ts"].alias("start_time"), w["peak_ts"].alias("peak_time"),
        F.when(w.isNotNull(), retracement(F.col("bars"), w)).alias("retracement"),
        F.when(w.isNotNull(), false_starts(F.col("_s"), F.col("_i"), zone)).otherwise(0).alias("false_starts"),
    )


SWING_FIELDS = ("direction", "magnitude", "start_time", "peak_time", "retracement", "false_starts")


def swing_day_features(
    bars: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = (20, 30, 40), default: float = 30,
    zone_low: float = 100, zone_high: float = 150,
) -> DataFrame:
    """Six columns per threshold and the two capture-zone flags of the default threshold."""
    long = largest_swings(bars, keys, thresholds, zone_low)
    aggs = []
    for t in thresholds:
        here = F.col("threshold") == float(t)
        aggs += [F.max(F.when(here, F.col(f))).alias(f"swing_{t:g}_{f}") for f in SWING_FIELDS]
    wide = long.groupBy(*keys).agg(*aggs)
    size = F.col(f"swing_{default:g}_magnitude")
    return wide.withColumns({
        "capture_zone_100": F.coalesce(size >= zone_low, F.lit(False)),
        "capture_zone_150": F.coalesce(size >= zone_high, F.lit(False)),
    })
