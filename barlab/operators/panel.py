"""Point-in-time features per symbol and date.

Every family is a set of row-frame windows over one (symbol, date) order, so
they share a single exchange and sort; no frame looks ahead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.expanding import expanding_ranks
from barlab.functions.scalars import bucket_index, to_minutes
from barlab.functions.windows import (
    bar_number, centred_extreme, forward_fill, nonzero, one_series, pct_change, ratio, roll, rolling_beta,
    rolling_corr, series, trail, trailing_zscore,
)
from barlab.operators.calendar import panel_calendar

# Window lengths and minimum rows.
MIN_ROWS = 10
MIN_HISTORY = 60
REGIME_EDGES = (0.25, 0.50, 0.75)


def expanding_rank(df: DataFrame, value: str, min_rows: int, name: str, key: str = "symbol", order: str = "date") -> DataFrame:
    return df.join(expanding_ranks(df, value, min_rows, name, key, order), [key, order], "left")


def return_features(bars: DataFrame) -> DataFrame:
    w = series()
    close, opened, prev = F.col("close"), F.col("open"), F.col("prev_close")
    out = bars.withColumns({
        "prev_close": F.lag("close").over(w),
        **{f"ret_{n}d": pct_change(close, n, w) for n in (1, 5, 10, 20)},
    })
    return out.withColumns({
        "abs_ret_1d": F.abs("ret_1d"),
        "gap_pct": ratio(opened, prev) - 1,
        "abs_gap_pct": F.abs(ratio(opened, prev) - 1),
        "overnight_vs_intraday": ratio(opened, prev) - 1 - (ratio(close, opened) - 1),
    })


def candle_shape(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - low
    return bars.withColumns({
        "range_pct": ratio(span, c),
        "body_pct": ratio(F.abs(c - o), c),
        "upper_wick_pct": ratio(h - F.greatest(o, c), c),
        "lower_wick_pct": ratio(F.least(o, c) - low, c),
        "body_to_range": ratio(F.abs(c - o), span),
        "close_position_in_range": ratio(c - low, span),
        "signed_body": ratio(c - o, c),
    })


def volatility_features(bars: DataFrame) -> DataFrame:
    """Needs the return and candle columns."""
    w = series()
    h, low, c, prev = (F.col(x) for x in ("high", "low", "close", "prev_close"))
    true_range = F.greatest(h - low, F.abs(h - prev), F.abs(low - prev))
    out = bars.withColumns({
        "_tr": true_range,
        "_hl2": F.pow(F.log(h / low), F.lit(2.0)),
        "rvol_5d": roll(F.stddev_samp, F.col("ret_1d"), 5, 3, w),
        "rvol_20d": roll(F.stddev_samp, F.col("ret_1d"), 20, MIN_ROWS, w),
    })
    out = out.withColumns({
        "atr_pct": ratio(roll(F.avg, F.col("_tr"), 14, MIN_ROWS, w), c),
        "vol_ratio_short_long": ratio(F.col("rvol_5d"), F.col("rvol_20d")),
        "parkinson_vol_20d": F.sqrt(roll(F.avg, F.col("_hl2"), 20, MIN_ROWS, w) / (4 * F.log(F.lit(2.0)))),
        "vol_of_vol_20d": roll(F.stddev_samp, F.col("rvol_5d"), 20, MIN_ROWS, w),
        "range_zscore_20d": trailing_zscore(F.col("range_pct"), 20, MIN_ROWS, w),
        "abs_ret_zscore_20d": trailing_zscore(F.col("abs_ret_1d"), 20, MIN_ROWS, w),
        "vol_expansion": ratio(F.col("rvol_5d"), trail(F.avg, F.col("rvol_5d"), 20, MIN_ROWS, w)),
    })
    return out.drop("_tr", "_hl2")


def regime_columns(bars: DataFrame) -> DataFrame:
    """Where yesterday's long volatility sits in the symbol's own history, keyed by (symbol, date)."""
    out = expanding_ranks(bars, "rvol_20d", MIN_HISTORY, "vol_regime")
    return out.withColumn("vol_regime_bucket", bucket_index(F.col("vol_regime"), REGIME_EDGES).cast("double"))


def regime_features(bars: DataFrame) -> DataFrame:
    return bars.join(regime_columns(bars), ["symbol", "date"], "left")


def volume_features(bars: DataFrame) -> DataFrame:
    w = series()
    v = F.col("volume").cast("double")
    turnover = F.col("close") * v
    short = ratio(v, trail(F.avg, v, 5, 5, w))
    long = ratio(v, trail(F.avg, v, 20, MIN_ROWS, w))
    out = bars.withColumns({
        "volume_ratio_5d": short,
        "volume_ratio_20d": long,
        "volume_zscore_20d": trailing_zscore(v, 20, MIN_ROWS, w),
        "turnover_ratio_20d": ratio(turnover, trail(F.avg, turnover, 20, MIN_ROWS, w)),
        "_vol_chg": pct_change(v, 1, w),
    })
    return out.withColumns({
        "volume_trend_5_20": ratio(F.col("volume_ratio_5d"), F.col("volume_ratio_20d")),
        "volume_return_corr_20d": rolling_corr(F.col("_vol_chg"), F.col("abs_ret_1d"), 20, MIN_ROWS, w),
    }).drop("_vol_chg")


def trend_features(bars: DataFrame) -> DataFrame:
    w = series()
    c = F.col("close")
    up = F.coalesce((F.col("ret_1d") > 0).cast("double"), F.lit(0.0))
    out = bars.withColumns({
        "_sma20": roll(F.avg, c, 20, MIN_ROWS, w),
        "_sma50": roll(F.avg, c, 50, MIN_ROWS, w),
        "close_to_high_20d": ratio(c, roll(F.max, F.col("high"), 20, MIN_ROWS, w)) - 1,
        "close_to_low_20d": ratio(c, roll(F.min, F.col("low"), 20, MIN_ROWS, w)) - 1,
        "_up": up,
        "_sign": F.signum("ret_1d"),
    })
    return out.withColumns({
        "dist_sma20": ratio(c, F.col("_sma20")) - 1,
        "dist_sma50": ratio(c, F.col("_sma50")) - 1,
        "sma20_slope_5d": pct_change(F.col("_sma20"), 5, w),
        "pct_up_days_20d": trail(F.avg, F.col("_up"), 20, MIN_ROWS, w),
        "consec_direction": roll(F.sum, F.col("_sign"), 3, 3, w),
    }).drop("_sma20", "_sma50", "_up", "_sign")


def swing_geometry(bars: DataFrame, k: int = 3, structure: int = 20) -> DataFrame:
    """Distances to the last confirmed pivots; a pivot becomes visible ``k`` rows later."""
    w = series()
    high, low, c = F.col("high"), F.col("low"), F.col("close")
    out = bars.withColumns({
        "_ph": F.when(high >= centred_extreme(F.max, high, k, w), high),
        "_pl": F.when(low <= centred_extreme(F.min, low, k, w), low),
        "_pos": bar_number(w),
    })
    out = out.withColumns({"_ph": F.lag("_ph", k).over(w), "_pl": F.lag("_pl", k).over(w)})
    out = out.withColumns({
        "_last_ph": forward_fill(F.col("_ph"), w),
        "_last_pl": forward_fill(F.col("_pl"), w),
        "_ph_pos": forward_fill(F.when(F.col("_ph").isNotNull(), F.col("_pos")), w),
        "_pl_pos": forward_fill(F.when(F.col("_pl").isNotNull(), F.col("_pos")), w),
        "pivot_count_20d": (
            F.count("_ph").over(w.rowsBetween(-(structure - 1), 0)) + F.count("_pl").over(w.rowsBetween(-(structure - 1), 0))
        ).cast("double"),
    })
    ph, pl = F.col("_last_ph"), F.col("_last_pl")
    out = out.withColumns({
        "dist_from_pivot_high": ratio(c, ph) - 1,
        "dist_from_pivot_low": ratio(c, pl) - 1,
        "swing_amplitude_pct": ratio(F.abs(ph - pl), c),
        "bars_since_pivot_high": (F.col("_pos") - F.col("_ph_pos")).cast("double"),
        "bars_since_pivot_low": (F.col("_pos") - F.col("_pl_pos")).cast("double"),
        "last_pivot_was_high": F.coalesce(F.col("_ph_pos") > F.col("_pl_pos"), F.lit(False)).cast("double"),
        "swing_retracement": ratio(c - pl, ph - pl),
        "higher_highs_20d": F.coalesce(ph > F.lag("_last_ph", structure).over(w), F.lit(False)).cast("double"),
        "higher_lows_20d": F.coalesce(pl > F.lag("_last_pl", structure).over(w), F.lit(False)).cast("double"),
    })
    out = out.withColumn(
        "swing_speed", F.col("swing_amplitude_pct") / (F.col("bars_since_pivot_high") + F.col("bars_since_pivot_low") + 1)
    )
    return out.drop("_ph", "_pl", "_pos", "_last_ph", "_last_pl", "_ph_pos", "_pl_pos")


def intraday_features(bars: DataFrame, first_hour_end: str = "10:15", last_hour_start: str = "14:30") -> DataFrame:
    """Session shape per symbol and date from intraday bars: one window, one aggregate, one exchange."""
    w = series(["symbol", "d"], "ts")
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    early, late = F.col("t") <= to_minutes(first_hour_end), F.col("t") >= to_minutes(last_hour_start)
    lagged = bars.where((c > 0) & (o > 0)).withColumn("_prev", F.lag("close").over(w))
    step = c - F.col("_prev")
    day = lagged.groupBy("symbol", "d").agg(
        F.count(F.lit(1)).alias("intraday_bar_count"),
        F.min_by("open", "t").alias("_open"), F.max_by("close", "t").alias("_close"),
        F.max("high").alias("_high"), F.min("low").alias("_low"),
        ratio(F.sum((h + low + c) / 3 * v), F.sum("volume")).alias("_vwap"),
        F.max_by(F.when(early, c), F.when(early, F.col("t"))).alias("_early_close"),
        F.min_by(F.when(late, o), F.when(late, F.col("t"))).alias("_late_open"),
        F.sum(F.when(early, v)).alias("_early_volume"), F.sum(F.when(late, v)).alias("_late_volume"),
        F.sum("volume").alias("_volume"), F.sum(F.abs(step)).alias("_path"),
        F.stddev_samp(step / nonzero(F.col("_prev"))).alias("intraday_bar_vol"),
        F.max(F.when(early, h)).alias("_early_high"), F.min(F.when(early, low)).alias("_early_low"),
    )
    g = F.col
    return day.select(
        "symbol", F.col("d").alias("date"), "intraday_bar_count",
        (ratio(g("_early_close"), g("_open")) - 1).alias("first_hour_ret"),
        (ratio(g("_close"), g("_late_open")) - 1).alias("last_hour_ret"),
        ratio(g("_high") - g("_low"), g("_open")).alias("intraday_range_pct"),
        (ratio(g("_high"), g("_open")) - 1).alias("intraday_runup_pct"),
        (ratio(g("_low"), g("_open")) - 1).alias("intraday_drawdown_pct"),
        (ratio(g("_close"), g("_vwap")) - 1).alias("close_vs_vwap"),
        ratio(F.abs(g("_close") - g("_open")), g("_path")).alias("intraday_efficiency"),
        "intraday_bar_vol",
        ratio(g("_early_volume"), g("_volume")).alias("first_hour_volume_share"),
        ratio(g("_late_volume"), g("_volume")).alias("last_hour_volume_share"),
        ratio(g("_early_high") - g("_early_low"), g("_high") - g("_low")).alias("first_hour_range_share"),
    )


def market_features(index_daily: DataFrame, vix_daily: DataFrame) -> DataFrame:
    """Index and volatility context, one row per market date (bounded by the calendar)."""
    w = one_series("date")
    c = F.col("close")
    index = index_daily.select(
        "date", c.alias("index_close"), pct_change(c, 1, w).alias("index_ret_1d"), pct_change(c, 5, w).alias("index_ret_5d"),
        ratio(F.col("high") - F.col("low"), c).alias("index_range_pct"),
    )
    index = index.withColumns({
        "index_rvol_20d": roll(F.stddev_samp, F.col("index_ret_1d"), 20, MIN_ROWS, w),
        "index_abs_ret_1d": F.abs("index_ret_1d"),
    })
    vix = vix_daily.select(
        F.lit("vix").alias("symbol"), "date", c.alias("vix_level"), pct_change(c, 1, w).alias("vix_change_pct"),
        trailing_zscore(c, 20, MIN_ROWS, w).alias("vix_zscore_20d"),
    )
    vix = expanding_rank(vix, "vix_level", MIN_HISTORY, "vix_percentile").drop("symbol")
    return index.join(vix, "date", "left")


def relative_features(panel: DataFrame) -> DataFrame:
    """Beta, correlation and relative strength; needs returns and the market columns."""
    w = series()
    r, m = F.col("ret_1d"), F.col("index_ret_1d")
    frame = w.rowsBetween(-19, 0)
    grown = F.aggregate(F.collect_list(m).over(frame), F.lit(1.0), lambda acc, x: acc * (1 + x)) - 1
    # a null inside the frame makes the product unknown, as it does for a raw array
    complete = F.count(m).over(frame) == F.count(F.lit(1)).over(frame)
    compounded = F.when(complete & (F.count(m).over(frame) >= MIN_ROWS), grown)
    return panel.withColumns({
        "beta_60d": rolling_beta(r, m, 60, MIN_ROWS, w),
        "corr_index_20d": rolling_corr(r, m, 20, MIN_ROWS, w),
        "rel_strength_20d": F.col("ret_20d") - compounded,
        "idio_vol_ratio": ratio(F.col("rvol_20d"), F.col("index_rvol_20d")),
    })


def window_families(bars: DataFrame) -> DataFrame:
    """Return, candle, volatility, volume, trend and swing families: one exchange, one sort."""
    out = volatility_features(candle_shape(return_features(bars)))
    return swing_geometry(trend_features(volume_features(out)))


def feature_panel(
    bars_daily: DataFrame,
    intraday: DataFrame | None,
    index_daily: DataFrame,
    vix_daily: DataFrame,
    first_hour_end: str = "10:15",
    last_hour_start: str = "14:30",
) -> DataFrame:
    """All families on (symbol, date); missing values stay null.

    Everything ordered by symbol runs first, market rows (one per date) join in
    between, and the two joins on (symbol, date) come last, so the wide rows are
    exchanged twice in all.
    """
    market = market_features(index_daily, vix_daily)
    core = window_families(bars_daily)
    panel = relative_features(core.join(market, "date", "left"))
    panel = panel.join(regime_columns(core), ["symbol", "date"], "left")
    if intraday is not None:
        panel = panel.join(intraday_features(intraday, first_hour_end, last_hour_start), ["symbol", "date"], "left")
    return panel_calendar(panel)


# the two learning matrices

STOCK_FEATURES = (
    "return_pct", "abs_return_pct", "gap_pct", "abs_gap_pct", "range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct",
    "volume_ratio_20d", "volume_zscore_20d", "range_zscore_20d", "return_zscore_20d", "open_close_ratio",
)
MARKET_FEATURES = (
    "session_range_pct", "gap_pct", "dvr_ratio", "vix_level", "vix_change_pct", "body_pct", "upper_wick_ratio", "lower_wick_ratio",
)


def stock_day_features(bars: DataFrame) -> DataFrame:
    """Thirteen scale-free columns over the open, neutral where history is missing."""
    w = series()
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    v, prev = F.col("volume").cast("double"), F.lag("close").over(w)
    out = bars.withColumn("_prev", prev)
    prev = F.col("_prev")
    out = out.withColumns({
        "return_pct": ratio(c - prev, prev), "abs_return_pct": F.abs(ratio(c - prev, prev)),
        "gap_pct": ratio(o - prev, prev), "abs_gap_pct": F.abs(ratio(o - prev, prev)),
        "range_pct": ratio(h - low, o), "body_pct": ratio(F.abs(c - o), o),
        "upper_wick_pct": ratio(h - F.greatest(o, c), o), "lower_wick_pct": ratio(F.least(o, c) - low, o),
        "open_close_ratio": ratio(o, prev),
        "volume_ratio_20d": ratio(v, trail(F.avg, v, 20, MIN_ROWS, w)),
        "volume_zscore_20d": trailing_zscore(v, 20, MIN_ROWS, w),
    })
    out = out.withColumns({
        "range_zscore_20d": trailing_zscore(F.col("range_pct"), 20, MIN_ROWS, w),
        "return_zscore_20d": trailing_zscore(F.col("abs_return_pct"), 20, MIN_ROWS, w),
    })
    neutral = {f: (1.0 if f in ("open_close_ratio", "volume_ratio_20d") else 0.0) for f in STOCK_FEATURES}
    return out.select("symbol", "date", "volume", *STOCK_FEATURES).na.fill(neutral)


def market_day_features(session: DataFrame, vix: DataFrame) -> DataFrame:
    """Eight columns per market day; days with any gap are dropped."""
    o, h, low, c = (F.col(f"session_{x}") for x in ("open", "high", "low", "close"))
    shaped = session.select(
        "date", ratio(h - low, o).alias("session_range_pct"), "gap_pct", "dvr_ratio", ratio(F.abs(c - o), o).alias("body_pct"),
        ratio(h - F.greatest(o, c), h - low).alias("upper_wick_ratio"), ratio(F.least(o, c) - low, h - low).alias("lower_wick_ratio"),
    )
    level = vix.select("date", F.col("vix_close").alias("vix_level"), "vix_change_pct")
    return shaped.join(level, "date", "left").dropna(subset=list(MARKET_FEATURES)).select("date", *MARKET_FEATURES)
