"""Session, volatility and day-range features of a market day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import banded, to_minutes
from barlab.functions.windows import nonzero, one_series, pct_change, ratio
from barlab.operators.aggregates import feasibility

# Volatility bands as [lower, upper) and the intraday cut-offs.
VOL_BANDS = (
    ("tight", 0, 11),
    ("functional", 11, 13),
    ("golden", 13, 18),
    ("elevated", 18, 22),
    ("spreads_only", 22, 25),
    ("no_trade", 25, 9999),
)
RANGE_CUTS = ("10:15", "11:15", "12:15", "13:15", "14:15", "15:15")


def session_features(daily: DataFrame, vix: DataFrame, dvr_divisor: float = 16) -> DataFrame:
    """Range, gap and the expected daily range from the volatility open."""
    w = one_series("date")
    base = daily.select(
        "date", *[F.col(x).alias(f"session_{x}") for x in ("open", "high", "low", "close")],
        (F.col("high") - F.col("low")).alias("session_range"), F.lag("close").over(w).alias("prev_close"),
    ).join(vix.select("date", F.col("open").alias("_vix_open")), "date", "left")
    out = base.withColumns({
        "gap": F.col("session_open") - F.col("prev_close"),
        "gap_pct": ratio(F.col("session_open") - F.col("prev_close"), F.col("prev_close")),
        "dvr": F.col("session_open") * (F.col("_vix_open") / 100) / dvr_divisor,
    })
    return out.withColumn("dvr_ratio", ratio(F.col("session_range"), F.col("dvr"))).drop("_vix_open")


def dvr_consumed(bars: DataFrame, session: DataFrame, cuts: Sequence[str] = RANGE_CUTS) -> DataFrame:
    """Share of the expected range used up by each cut-off: one aggregate per day."""
    aggs = []
    for i, c in enumerate(cuts, 1):
        upto = F.col("t") <= to_minutes(c)
        span = F.max(F.when(upto, F.col("high"))) - F.min(F.when(upto, F.col("low")))
        aggs.append(span.alias(f"_h{i}"))
    days = bars.groupBy("d").agg(*aggs).withColumnRenamed("d", "date")
    joined = days.join(session.select("date", "dvr"), "date", "left")
    ok = F.col("dvr") > 0
    return joined.select("date", *[F.when(ok, F.col(f"_h{i}") / F.col("dvr")).alias(f"dvr_consumed_h{i}") for i in range(1, len(cuts) + 1)])


def vix_features(vix: DataFrame, bands=VOL_BANDS, downgrade: float = 0.05) -> DataFrame:
    """Direction, change and band of the volatility index; ties and the first day count as falling."""
    w = one_series("date")
    out = vix.select(
        "date", F.col("open").alias("vix_open"), F.col("close").alias("vix_close"),
        F.lag("close").over(w).alias("vix_prev_close"), pct_change(F.col("close"), 1, w).alias("vix_change_pct"),
    )
    rising = F.coalesce(F.col("vix_close") > F.col("vix_prev_close"), F.lit(False))
    return out.withColumns({
        "vix_direction": F.when(rising, "rising").otherwise("falling"),
        "vix_downgrade": F.coalesce(F.col("vix_change_pct") > downgrade, F.lit(False)),
        "vix_regime": banded(F.col("vix_close"), bands),
    })


def master_day_table(session: DataFrame, consumed: DataFrame, vix: DataFrame, swings: DataFrame, calendar: DataFrame) -> DataFrame:
    """All day features on one row per date; the first day has no previous close and is dropped."""
    out = session
    for part in (consumed, vix, swings, calendar):
        out = out.join(part, "date", "left")
    out = out.withColumn("vix_data_missing", F.col("vix_regime").isNull())
    first = session.agg(F.min("date")).scalar()
    return out.where(F.col("date") > first)


def load_master(master: DataFrame, start: str, end: str) -> DataFrame:
    return master.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


COLUMN_GROUPS = {
    "session": ("session_",), "dvr_base": ("dvr", "dvr_ratio"), "dvr_consumed": ("dvr_consumed",), "vix": ("vix_",),
    "swing": ("swing_",), "capture_zone": ("capture_zone",),
    "calendar": ("day_of_week", "week_of_month", "month", "is_expiry_day", "is_no_trade_day", "is_event_day", "is_pre_event",
                 "is_post_event"),
}


def master_nulls(master: DataFrame) -> DataFrame:
    """Missing values per column group."""
    sums = {}
    for group, names in COLUMN_GROUPS.items():
        if group in ("dvr_base", "calendar"):
            columns = [c for c in master.columns if c in names]
        else:
            columns = [c for c in master.columns if c.startswith(names[0])]
        if columns:
            missing = F.lit(0)
            for c in columns:
                missing = missing + F.col(c).isNull().cast("int")
            sums[group] = F.sum(missing)
    one = master.agg(*[x.alias(g) for g, x in sums.items()])
    return one.unpivot([], list(sums), "column_group", "missing")


def master_regimes(master: DataFrame) -> DataFrame:
    """Days and capture-zone hits per volatility regime."""
    known = F.col("capture_zone_100").isNotNull()
    return master.groupBy("vix_regime").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(known).alias("swing_days"),
        F.count_if("capture_zone_100").alias("hits_100"), F.count_if("capture_zone_150").alias("hits_150"),
    )


# range and swing tables; groups hold calendar days, so exact medians fit one buffer


def range_stats(master: DataFrame, key: str, value: str = "session_range") -> DataFrame:
    valid = master.where(F.col("vix_regime").isNotNull() & F.col(value).isNotNull())
    return valid.groupBy(key).agg(
        F.count(F.lit(1)).alias("days"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def capture_feasibility(master: DataFrame, thresholds: Sequence[float] = (100, 150, 200, 250)) -> DataFrame:
    valid = master.where(F.col("vix_regime").isNotNull() & F.col("session_range").isNotNull())
    return feasibility(valid, "vix_regime", "session_range", thresholds)


def dvr_ratio_by_regime(master: DataFrame) -> DataFrame:
    used = master.where(F.col("vix_regime").isNotNull() & (F.col("dvr") > 0))
    x = ratio(F.col("session_range"), F.col("dvr"))
    return used.withColumn("_x", x).groupBy("vix_regime").agg(
        F.count("_x").alias("days"), F.avg("_x").alias("mean_ratio"), F.median("_x").alias("median_ratio"),
        F.stddev_samp("_x").alias("std_ratio"),
    )


def _move_stats(rows: DataFrame, key: str, low: float, high: float) -> DataFrame:
    m = F.col("magnitude")
    return rows.where(m.isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("days"),
        (F.avg((m >= low).cast("double")) * 100).alias("ge_low_pct"), (F.avg((m >= high).cast("double")) * 100).alias("ge_high_pct"),
        F.median("magnitude").alias("median_swing"), F.avg("magnitude").alias("mean_swing"),
        F.avg("false_starts").alias("mean_false_starts"),
    )


def swing_by_threshold(master: DataFrame, thresholds: Sequence[float], low: float = 100, high: float = 150) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("reversal_threshold"), F.col(f"swing_{t:g}_magnitude").alias("magnitude"),
                 F.col(f"swing_{t:g}_false_starts").alias("false_starts")) for t in thresholds
    ])
    return _move_stats(master.select(F.inline(rows)), "reversal_threshold", low, high)


def swing_by_regime(master: DataFrame, threshold: float, low: float = 100, high: float = 150) -> DataFrame:
    rows = master.select("vix_regime", F.col(f"swing_{threshold:g}_magnitude").alias("magnitude"),
                         F.col(f"swing_{threshold:g}_false_starts").alias("false_starts"))
    return _move_stats(rows.where(F.col("vix_regime").isNotNull()), "vix_regime", low, high)


def directionality(master: DataFrame, threshold: float) -> DataFrame:
    """How much of the day's range one clean swing covers."""
    m, r = F.col(f"swing_{threshold:g}_magnitude"), F.col("session_range")
    used = master.where((m > 0) & (r > 0) & F.col("vix_regime").isNotNull())
    return used.groupBy("vix_regime").agg(
        F.count(F.lit(1)).alias("days"), F.avg(r).alias("avg_range"), F.avg(m).alias("avg_swing"),
        (F.avg(m / nonzero(r)) * 100).alias("directionality"),
    )
