"""Queries for the feature panel, labels and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import filters as FL
from barlab.operators import labels as LB
from barlab.operators import panel as P
from barlab.operators import splits as SP
from barlab.plans.market_days import PANEL_CAL_SQL, session
from barlab.plans.registry import query
from barlab.plans.relational import WS, roll_sql, trail_sql, z_sql
from barlab.plans.sql_base import table
from barlab.operators import days as D

C = F.col


def ret(x: str, n: int) -> str:
    return f"{x} / nullif(lag({x}, {n}) OVER {WS}, 0) - 1"


def cov(x: str, y: str, n: int, mp: int) -> str:
    return f"(({roll_sql('avg', f'{x} * {y}', n, mp)}) - ({roll_sql('avg', x, n, mp)}) * ({roll_sql('avg', y, n, mp)}))"


def corr(x: str, y: str, n: int, mp: int) -> str:
    return f"{cov(x, y, n, mp)} / nullif(({roll_sql('stddev_samp', x, n, mp)}) * ({roll_sql('stddev_samp', y, n, mp)}), 0)"


table("x_p1", f"""
  SELECT *, abs(ret_1d) AS abs_ret_1d, open / prev_close - 1 AS gap_pct, abs(open / prev_close - 1) AS abs_gap_pct,
    open / prev_close - 1 - (close / open - 1) AS overnight_vs_intraday, (high - low) / close AS range_pct, abs(close - open) / close AS body_pct,
    (high - greatest(open, close)) / close AS upper_wick_pct, (least(open, close) - low) / close AS lower_wick_pct,
    abs(close - open) / nullif(high - low, 0) AS body_to_range, (close - low) / nullif(high - low, 0) AS close_position_in_range,
    (close - open) / close AS signed_body, CAST(volume AS DOUBLE) AS v,
    CASE WHEN prev_close IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr,
    pow(ln(high / low), 2) AS hl2 FROM (
    SELECT *, lag(close) OVER {WS} AS prev_close, {', '.join(f'{ret("close", n)} AS ret_{n}d' for n in (1, 5, 10, 20))} FROM x_bars)""")
table("x_p2", f"""
  SELECT *, {roll_sql('stddev_samp', 'ret_1d', 5, 3)} AS rvol_5d, {roll_sql('stddev_samp', 'ret_1d', 20, 10)} AS rvol_20d,
    {ret('v', 1)} AS vol_chg, v / nullif({trail_sql('avg', 'v', 5, 5)}, 0) AS volume_ratio_5d,
    v / nullif({trail_sql('avg', 'v', 20, 10)}, 0) AS volume_ratio_20d, {z_sql('v', 20, 10)} AS volume_zscore_20d,
    close * v / nullif({trail_sql('avg', 'close * v', 20, 10)}, 0) AS turnover_ratio_20d,
    {roll_sql('avg', 'tr', 14, 10)} / close AS atr_pct, sqrt({roll_sql('avg', 'hl2', 20, 10)} / (4 * ln(2.0))) AS parkinson_vol_20d,
    {z_sql('range_pct', 20, 10)} AS range_zscore_20d, {z_sql('abs_ret_1d', 20, 10)} AS abs_ret_zscore_20d,
    {roll_sql('avg', 'close', 20, 10)} AS sma20, {roll_sql('avg', 'close', 50, 10)} AS sma50,
    close / {roll_sql('max', 'high', 20, 10)} - 1 AS close_to_high_20d, close / {roll_sql('min', 'low', 20, 10)} - 1 AS close_to_low_20d,
    CASE WHEN ret_1d > 0 THEN 1.0 ELSE 0.0 END AS up_day, sign(ret_1d) AS sgn FROM x_p1""")
table("x_p3", f"""
  SELECT *, rvol_5d / nullif(rvol_20d, 0) AS vol_ratio_short_long, {roll_sql('stddev_samp', 'rvol_5d', 20, 10)} AS vol_of_vol_20d,
    rvol_5d / nullif({trail_sql('avg', 'rvol_5d', 20, 10)}, 0) AS vol_expansion, volume_ratio_5d / nullif(volume_ratio_20d, 0) AS volume_trend_5_20,
    {corr('vol_chg', 'abs_ret_1d', 20, 10)} AS volume_return_corr_20d, close / sma20 - 1 AS dist_sma20, close / sma50 - 1 AS dist_sma50,
    {ret('sma20', 5)} AS sma20_slope_5d, {trail_sql('avg', 'up_day', 20, 10)} AS pct_up_days_20d, {roll_sql('sum', 'sgn', 3, 3)} AS consec_direction,
    row_number() OVER {WS} AS n FROM x_p2""")
table("x_regime", """
  SELECT symbol, date, vol_regime, CASE WHEN r >= 0.75 THEN 3 WHEN r >= 0.5 THEN 2 WHEN r >= 0.25 THEN 1 ELSE 0 END AS vol_regime_bucket
  FROM (SELECT *, coalesce(vol_regime, 0.5) AS r FROM (
    SELECT a.symbol, a.date, CASE WHEN a.y IS NOT NULL AND count(h.v) >= 60 THEN
      (count(*) FILTER (WHERE h.v < a.y) + (count(*) FILTER (WHERE h.v = a.y) + 1) / 2.0) / count(h.v) END AS vol_regime
    FROM (SELECT symbol, date, n, lag(rvol_20d) OVER (PARTITION BY symbol ORDER BY n) AS y FROM x_p3) a
    LEFT JOIN (SELECT symbol, n, rvol_20d AS v FROM x_p3) h ON h.symbol = a.symbol AND h.n < a.n GROUP BY a.symbol, a.date, a.y))""")
table("x_geo", f"""
  SELECT *, swing_amplitude_pct / (bars_since_pivot_high + bars_since_pivot_low + 1) AS swing_speed FROM (
    SELECT symbol, date, close / ph - 1 AS dist_from_pivot_high, close / pl - 1 AS dist_from_pivot_low, abs(ph - pl) / close AS swing_amplitude_pct,
      n - php AS bars_since_pivot_high, n - plp AS bars_since_pivot_low, CASE WHEN php > plp THEN 1 ELSE 0 END AS last_pivot_was_high,
      (close - pl) / nullif(ph - pl, 0) AS swing_retracement, pivots AS pivot_count_20d,
      CASE WHEN ph > lag(ph, 20) OVER {WS} THEN 1 ELSE 0 END AS higher_highs_20d, CASE WHEN pl > lag(pl, 20) OVER {WS} THEN 1 ELSE 0 END AS higher_lows_20d
    FROM (SELECT *, last_value(p_h IGNORE NULLS) OVER u AS ph, last_value(p_l IGNORE NULLS) OVER u AS pl,
        last_value(CASE WHEN p_h IS NOT NULL THEN n END IGNORE NULLS) OVER u AS php, last_value(CASE WHEN p_l IS NOT NULL THEN n END IGNORE NULLS) OVER u AS plp,
        count(p_h) OVER q + count(p_l) OVER q AS pivots
      FROM (SELECT *, lag(h7, 3) OVER {WS} AS p_h, lag(l7, 3) OVER {WS} AS p_l FROM (
        SELECT symbol, date, close, row_number() OVER {WS} AS n, CASE WHEN count(*) OVER c = 7 AND high >= max(high) OVER c THEN high END AS h7,
          CASE WHEN count(*) OVER c = 7 AND low <= min(low) OVER c THEN low END AS l7 FROM x_bars
        WINDOW c AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)))
      WINDOW u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING),
        q AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))""")
EARLY, LATE = 420, 1020
table("x_shape", f"""
  SELECT symbol, d AS date, n AS intraday_bar_count, ec / nullif(o, 0) - 1 AS first_hour_ret, c / nullif(lo_open, 0) - 1 AS last_hour_ret,
    (h - l) / nullif(o, 0) AS intraday_range_pct, h / nullif(o, 0) - 1 AS intraday_runup_pct, l / nullif(o, 0) - 1 AS intraday_drawdown_pct,
    c / nullif(vw, 0) - 1 AS close_vs_vwap, abs(c - o) / nullif(path, 0) AS intraday_efficiency, intraday_bar_vol,
    ev / nullif(tv, 0) AS first_hour_volume_share, lv / nullif(tv, 0) AS last_hour_volume_share, (eh - el) / nullif(h - l, 0) AS first_hour_range_share
  FROM (SELECT symbol, d, count(*) AS n, arg_min(open, t) AS o, arg_max(close, t) AS c, max(high) AS h, min(low) AS l,
      sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vw, arg_max(close, t) FILTER (WHERE t <= {EARLY}) AS ec,
      arg_min(open, t) FILTER (WHERE t >= {LATE}) AS lo_open, sum(volume) FILTER (WHERE t <= {EARLY}) AS ev,
      sum(volume) FILTER (WHERE t >= {LATE}) AS lv, sum(volume) AS tv, sum(abs(close - p)) AS path,
      stddev_samp((close - p) / nullif(p, 0)) AS intraday_bar_vol, max(high) FILTER (WHERE t <= {EARLY}) AS eh, min(low) FILTER (WHERE t <= {EARLY}) AS el
    FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, d ORDER BY ts) AS p FROM x_hours WHERE close > 0 AND open > 0) GROUP BY 1, 2)""")


def flat(expr: str) -> str:
    """The same frames without a symbol."""
    return expr.replace("PARTITION BY symbol ", "")


table("x_mkt", f"""
  SELECT m.*, v.vix_level, v.vix_change_pct, v.vix_zscore_20d, p.vix_percentile FROM (
    SELECT *, abs(index_ret_1d) AS index_abs_ret_1d, {flat(roll_sql('stddev_samp', 'index_ret_1d', 20, 10))} AS index_rvol_20d FROM (
      SELECT date, close AS index_close, {flat(ret('close', 1))} AS index_ret_1d, {flat(ret('close', 5))} AS index_ret_5d,
        (high - low) / close AS index_range_pct FROM x_index)) m
  LEFT JOIN (SELECT date, close AS vix_level, {flat(ret('close', 1))} AS vix_change_pct, {flat(z_sql('close', 20, 10))} AS vix_zscore_20d FROM x_vix) v USING (date)
  LEFT JOIN (SELECT a.date, CASE WHEN count(h.v) >= 60 THEN (count(*) FILTER (WHERE h.v < a.y) + (count(*) FILTER (WHERE h.v = a.y) + 1) / 2.0) / count(h.v) END AS vix_percentile
    FROM (SELECT date, lag(close) OVER (ORDER BY date) AS y FROM x_vix) a JOIN (SELECT date, close AS v FROM x_vix) h ON h.date < a.date GROUP BY a.date, a.y) p USING (date)""")
table("x_rel", f"""
  SELECT symbol, date, {cov('ret_1d', 'index_ret_1d', 60, 10)} / nullif({roll_sql('var_samp', 'index_ret_1d', 60, 10)}, 0) AS beta_60d,
    {corr('ret_1d', 'index_ret_1d', 20, 10)} AS corr_index_20d,
    ret_20d - (CASE WHEN count(index_ret_1d) OVER f = count(*) OVER f AND count(*) OVER f >= 10
      THEN product(1 + index_ret_1d) OVER f - 1 END) AS rel_strength_20d,
    rvol_20d / nullif(index_rvol_20d, 0) AS idio_vol_ratio
  FROM (SELECT symbol, date, ret_1d, ret_20d, rvol_20d, index_ret_1d, index_rvol_20d FROM x_p3 LEFT JOIN x_mkt USING (date))
  WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
table("x_panel", f"""
  SELECT p.* EXCLUDE (n), g.* EXCLUDE (symbol, date), r.* EXCLUDE (symbol, date), s.* EXCLUDE (symbol, date), m.* EXCLUDE (date),
    e.* EXCLUDE (symbol, date), {PANEL_CAL_SQL.replace('date', 'p.date').replace('p.date_diff', 'date_diff')}
  FROM x_p3 p LEFT JOIN x_geo g USING (symbol, date) LEFT JOIN x_regime r USING (symbol, date) LEFT JOIN x_shape s USING (symbol, date)
  LEFT JOIN x_mkt m USING (date) LEFT JOIN x_rel e USING (symbol, date)""")


def rets(fx):
    return P.candle_shape(P.return_features(fx.bars_daily))


def daily(fx):
    return P.volatility_features(rets(fx))


def shape(fx):
    return P.intraday_features(fx.bars_intraday, "07:00", "17:00")


def market(fx):
    return P.market_features(fx.index_daily, fx.vix_daily)


def panel(fx):
    return P.feature_panel(fx.bars_daily, fx.bars_intraday, fx.index_daily, fx.vix_daily, "07:00", "17:00")


K = "symbol date:d "
_RET = "ret_1d:r ret_5d:r ret_10d:r ret_20d:r abs_ret_1d:r gap_pct:r abs_gap_pct:r overnight_vs_intraday:r"
_CANDLE = "range_pct:r body_pct:r upper_wick_pct:r lower_wick_pct:r body_to_range:r close_position_in_range:r signed_body:r"
_VOLUME = "volume_ratio_5d:r volume_ratio_20d:r volume_zscore_20d:r volume_trend_5_20:r turnover_ratio_20d:r"
_TREND = "dist_sma20:r dist_sma50:r sma20_slope_5d:r close_to_high_20d:r close_to_low_20d:r pct_up_days_20d:r consec_direction:r"
_SWING = ("dist_from_pivot_high:r dist_from_pivot_low:r swing_amplitude_pct:r bars_since_pivot_high:i bars_since_pivot_low:i "
          "last_pivot_was_high:i swing_retracement:r pivot_count_20d:i higher_highs_20d:i higher_lows_20d:i swing_speed:r")
_SHAPE = ("intraday_bar_count:i first_hour_ret:r last_hour_ret:r intraday_range_pct:r intraday_runup_pct:r intraday_drawdown_pct:r "
          "close_vs_vwap:r intraday_efficiency:r intraday_bar_vol:r first_hour_volume_share:r last_hour_volume_share:r first_hour_range_share:r")
_MKT = ("index_close:r index_ret_1d:r index_ret_5d:r index_rvol_20d:r index_abs_ret_1d:r index_range_pct:r vix_level:r vix_change_pct:r "
        "vix_zscore_20d:r vix_percentile:r")
_REL = "beta_60d:r corr_index_20d:r rel_strength_20d:r5 idio_vol_ratio:r"
_VOLA = "rvol_5d:r rvol_20d:r vol_ratio_short_long:r"


@query("pnl01_return_features", K + _RET, "SELECT * FROM x_p3")
def _(fx):
    return P.return_features(fx.bars_daily)


@query("pnl02_candle_shape", K + _CANDLE, "SELECT * FROM x_p3")
def _(fx):
    return P.candle_shape(fx.bars_daily)


@query("pnl03_atr_pct", K + "atr_pct:r", "SELECT * FROM x_p3")
def _(fx):
    return daily(fx)


@query("pnl04_realised_vol", K + _VOLA, "SELECT * FROM x_p3")
def _(fx):
    return daily(fx)


@query("pnl05_parkinson_vol", K + "parkinson_vol_20d:r", "SELECT * FROM x_p3")
def _(fx):
    return daily(fx)


@query("pnl06_vol_of_vol_zscores", K + "vol_of_vol_20d:r range_zscore_20d:r abs_ret_zscore_20d:r", "SELECT * FROM x_p3")
def _(fx):
    return daily(fx)


@query("pnl07_vol_regime", K + "vol_regime:r vol_regime_bucket:i vol_expansion:r", "SELECT * FROM x_p3 JOIN x_regime USING (symbol, date)")
def _(fx):
    return P.regime_features(daily(fx))


@query("pnl08_volume_features", K + _VOLUME, "SELECT * FROM x_p3")
def _(fx):
    return P.volume_features(daily(fx))


@query("pnl09_volume_return_corr", K + "volume_return_corr_20d:r", "SELECT * FROM x_p3")
def _(fx):
    return P.volume_features(daily(fx))


@query("pnl10_trend_features", K + _TREND, "SELECT * FROM x_p3")
def _(fx):
    return P.trend_features(daily(fx))


@query("pnl11_daily_swing_geometry", K + _SWING, "SELECT * FROM x_geo")
def _(fx):
    return P.swing_geometry(fx.bars_daily)


@query("pnl12_intraday_features", K + _SHAPE, "SELECT * FROM x_shape")
def _(fx):
    return shape(fx)


@query("pnl13_market_features", "date:d " + _MKT, "SELECT * FROM x_mkt")
def _(fx):
    return market(fx)


@query("pnl14_relative_features", K + _REL, "SELECT * FROM x_rel")
def _(fx):
    from barlab.operators.joins import attach_by_date

    return P.relative_features(attach_by_date(daily(fx), market(fx)))


_PANEL = " ".join([_RET, _CANDLE, "atr_pct:r", _VOLA, "parkinson_vol_20d:r vol_of_vol_20d:r vol_regime:r vol_regime_bucket:i vol_expansion:r",
                   _VOLUME, "volume_return_corr_20d:r", _TREND, _SWING, _SHAPE, _MKT, _REL,
                   "day_of_week:i day_of_month:i month:i days_to_month_end:i days_to_expiry:i is_expiry_week:i"])


@query("pnl15_feature_panel", K + _PANEL, "SELECT * FROM x_panel")
def _(fx):
    return panel(fx)


table("x_stock", f"""
  SELECT symbol, date, volume, coalesce(return_pct, 0) AS return_pct, coalesce(abs(return_pct), 0) AS abs_return_pct, coalesce(gap_pct, 0) AS gap_pct,
    coalesce(abs(gap_pct), 0) AS abs_gap_pct, range_pct, abs(close - open) / open AS body_pct, (high - greatest(open, close)) / open AS upper_wick_pct,
    (least(open, close) - low) / open AS lower_wick_pct, coalesce(v / nullif({trail_sql('avg', 'v', 20, 10)}, 0), 1) AS volume_ratio_20d,
    coalesce({z_sql('v', 20, 10)}, 0) AS volume_zscore_20d, coalesce({z_sql('range_pct', 20, 10)}, 0) AS range_zscore_20d,
    coalesce({z_sql('abs(return_pct)', 20, 10)}, 0) AS return_zscore_20d, coalesce(open / p, 1) AS open_close_ratio FROM (
    SELECT *, (close - p) / p AS return_pct, (open - p) / p AS gap_pct, (high - low) / open AS range_pct, CAST(volume AS DOUBLE) AS v
    FROM (SELECT *, lag(close) OVER {WS} AS p FROM x_bars))""")
table("x_market_day", """
  SELECT * FROM (SELECT s.date, session_range / nullif(session_open, 0) AS session_range_pct, gap_pct, dvr_ratio, v.vix_close AS vix_level, v.vix_change_pct,
      abs(session_close - session_open) / nullif(session_open, 0) AS body_pct,
      (session_high - greatest(session_open, session_close)) / nullif(session_range, 0) AS upper_wick_ratio,
      (least(session_open, session_close) - session_low) / nullif(session_range, 0) AS lower_wick_ratio
    FROM x_ses s LEFT JOIN x_volf v USING (date))
  WHERE gap_pct IS NOT NULL AND dvr_ratio IS NOT NULL AND vix_level IS NOT NULL AND vix_change_pct IS NOT NULL AND upper_wick_ratio IS NOT NULL
    AND session_range_pct IS NOT NULL""")


def stock_days(fx):
    return P.stock_day_features(fx.bars_daily)


def market_days(fx):
    return P.market_day_features(session(fx), D.vix_features(fx.vix_daily))


@query("pnl16_stock_day_features", K + "volume:i " + " ".join(f"{f}:r" for f in P.STOCK_FEATURES), "SELECT * FROM x_stock")
def _(fx):
    return stock_days(fx)


@query("pnl17_market_day_features", "date:d " + " ".join(f"{f}:r" for f in P.MARKET_FEATURES), "SELECT * FROM x_market_day")
def _(fx):
    return market_days(fx)


USABLE = [name for f in _PANEL.split() if (name := f.split(":")[0]) not in FL.BOOKKEEPING]


@query("prj12_usable_features", "feature filled:r varies:b usable:b",
       "WITH p AS MATERIALIZED (SELECT * FROM x_panel) "
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) / count(*) AS filled, coalesce(min({f}) < max({f}), false) AS varies, "
                            f"count({f}) / count(*) >= 0.01 AND coalesce(min({f}) < max({f}), false) AS usable FROM p" for f in USABLE)
       + " UNION ALL SELECT 'constant', 1.0, false, false UNION ALL SELECT 'sparse', 1.0 / count(*), false, false FROM p")
def _(fx):
    first = F.when((C("symbol") == "S0") & C("ret_1d").isNull(), 1.0)
    wide = panel(fx).select("symbol", "date", *[C(f).cast("double").alias(f) for f in USABLE], F.lit(1.0).alias("constant"), first.alias("sparse"))
    return FL.feature_usability(wide)


# labels

table("x_lab", f"""
  SELECT *, CASE WHEN label_valid THEN CASE WHEN fwd_abs_ret > label_threshold THEN 1.0 ELSE 0.0 END END AS y FROM (
    SELECT *, abs(fwd_ret) AS fwd_abs_ret, fwd_ret IS NOT NULL AND coalesce(label_threshold > 0, false) AND n > 60 AND NOT hit
        AND NOT coalesce(bool_or(hit) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
          AND lead(1, 2) OVER {WS} = 1, false) AS label_valid FROM (
      SELECT p.*, lead(close, 2) OVER {WS} / close - 1 AS fwd_ret, 1.5 * rvol_20d * sqrt(2.0) AS label_threshold,
        (symbol, date) IN (SELECT (symbol, ex_date) FROM x_corp) AS hit FROM x_p3 p))""")


def labelled(fx):
    return LB.add_labels(daily(fx), fx.corp_actions, horizon=2, vol_multiple=1.5)


@query("lbl01_add_labels", K + "fwd_ret:r fwd_abs_ret:r label_threshold:r y:i", "SELECT * FROM x_lab")
def _(fx):
    return labelled(fx)


@query("lbl02_label_valid", K + "label_valid:b", "SELECT * FROM x_lab")
def _(fx):
    return labelled(fx)


@query("lbl03_label_summary", "year:i rows:i base_rate:r mean_threshold:r mean_abs_fwd_ret:r",
       """SELECT year(date) AS year, count(*) AS rows, avg(y) AS base_rate, avg(label_threshold) AS mean_threshold,
          avg(fwd_abs_ret) AS mean_abs_fwd_ret FROM x_lab WHERE label_valid GROUP BY 1""")
def _(fx):
    return LB.label_summary(labelled(fx))


# splits

table("x_dates", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM x_bars)")


def folds_sql(source: str, n_folds: int, gap: int, least: int, expanding: bool = True) -> str:
    lo = "0" if expanding else f"greatest(0, hi - {least} * 2 + 1)"
    return f"""
      SELECT fold, CASE WHEN p BETWEEN t_lo AND t_hi THEN 'test' ELSE 'train' END AS role, date FROM (
        SELECT *, {lo} AS lo FROM (SELECT *, t_lo - {gap} - 1 AS hi FROM (
          SELECT *, f0 + fold * block AS t_lo, CASE WHEN fold = {n_folds - 1} THEN n - 1 ELSE f0 + (fold + 1) * block - 1 END AS t_hi FROM (
            SELECT *, (n - f0) // {n_folds} AS block FROM (SELECT *, greatest({least} + {gap}, CAST(floor(n * 0.35) AS BIGINT)) AS f0 FROM {source}))
          , (SELECT unnest(range({n_folds})) AS fold))))
      WHERE hi - lo + 1 >= {least} AND (p BETWEEN t_lo AND t_hi OR p BETWEEN lo AND hi)"""


table("x_folds", folds_sql("x_dates", 6, 11, 250))
table("x_train0", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM x_folds WHERE fold = 5 AND role = 'train'")


def folds(fx):
    return SP.purged_walk_forward(fx.bars_daily)


def last_train(fx):
    return folds(fx).where("fold = 5 AND role = 'train'").select("date")


@query("spl01_dev_eval_split", "date:d role",
       """SELECT date, CASE WHEN p < c THEN 'dev' WHEN p >= least(c + 11, n - 1) THEN 'eval' ELSE 'gap' END AS role
          FROM (SELECT *, CAST(floor(n * 0.6) AS BIGINT) AS c FROM x_dates)""")
def _(fx):
    return SP.dev_eval_split(fx.bars_daily)


@query("spl02_purged_walk_forward", "fold:i role date:d", "SELECT * FROM x_folds")
def _(fx):
    return folds(fx)


@query("spl02_sliding", "fold:i role date:d", folds_sql("x_dates", 6, 11, 250, False))
def _(fx):
    return SP.purged_walk_forward(fx.bars_daily, expanding=False)


@query("spl03_inner_folds", "fold:i role date:d", folds_sql("x_train0", 3, 11, 83))
def _(fx):
    return SP.inner_folds(fx.bars_daily, last_train(fx))


@query("spl04_chronological_holdout", "date:d fit:b validate:b",
       """SELECT date, s - 12 < 1 OR p <= s - 12 AS fit, s - 12 < 1 OR p >= s AS validate FROM (
            SELECT *, n - greatest(1, CAST(floor(n * 0.15) AS BIGINT)) AS s FROM x_train0)""")
def _(fx):
    return SP.chronological_holdout(last_train(fx))


@query("spl05_assert_no_leakage", "fold:i train_end:i test_start:i train_dates:i test_dates:i shared_dates:i gap_dates:i clean:b",
       """SELECT *, test_start - train_end - 1 AS gap_dates, shared_dates = 0 AND test_start - train_end - 1 >= 1 AS clean FROM (
            SELECT fold, max(p) FILTER (WHERE role = 'train') AS train_end, min(p) FILTER (WHERE role = 'test') AS test_start,
              count(*) FILTER (WHERE role = 'train') AS train_dates, count(*) FILTER (WHERE role = 'test') AS test_dates,
              count(*) - count(DISTINCT date) AS shared_dates FROM x_folds JOIN x_dates USING (date) GROUP BY 1)""")
def _(fx):
    return SP.assert_no_leakage(folds(fx), fx.bars_daily)
