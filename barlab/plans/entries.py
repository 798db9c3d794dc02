"""Queries for entry geometry and trade resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.scalars import to_minutes
from barlab.operators import geometry as G
from barlab.operators import trades as TR
from barlab.plans.ranking import long_rows
from barlab.plans.registry import query
from barlab.plans.relational import CPS
from barlab.plans.sql_base import table
from barlab.session import materialise

C = F.col
PERIOD, BACK, START, END = 14, 3, "06:00", "20:00"
CFG = TR.TradeConfig(huge_mult=2.0, stop_max=0.9, target_r=1.5, breakeven_r=1.0, force_close="21:00")
SWEEP = (1, 2, 3)
LOCK, SIZE = "06:00", 4

table("x_pos", """
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
    row_number() OVER (PARTITION BY symbol, d ORDER BY ts) - 1 AS bar_index FROM x_hours""")
table("x_tr", f"""
  SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr,
    CASE WHEN count(*) OVER f = {PERIOD} THEN avg(high - low) OVER f END AS avg_range,
    lag(low, {BACK}) OVER w AS low_back, lag(high, {BACK}) OVER w AS high_back FROM x_pos
  WINDOW w AS (PARTITION BY symbol ORDER BY pos),
    f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {PERIOD - 1} PRECEDING AND CURRENT ROW)""")
table("x_atr", f"""
  SELECT a.symbol, a.pos, max(s.seed) * pow({PERIOD - 1}.0 / {PERIOD}, a.pos - {PERIOD - 1})
    + coalesce(sum(j.tr / {PERIOD} * pow({PERIOD - 1}.0 / {PERIOD}, a.pos - j.pos)), 0) AS atr
  FROM x_tr a JOIN (SELECT symbol, avg(tr) AS seed FROM x_tr WHERE pos < {PERIOD} GROUP BY 1) s ON s.symbol = a.symbol
  LEFT JOIN x_tr j ON j.symbol = a.symbol AND j.pos >= {PERIOD} AND j.pos <= a.pos WHERE a.pos >= {PERIOD - 1} GROUP BY 1, 2""")
table("x_ind", """
  SELECT t.*, a.atr, lag(a.atr) OVER w AS atr_prev, lag(t.avg_range) OVER w AS avg_range_prev,
    first(t.open) OVER (PARTITION BY t.symbol, t.d ORDER BY t.pos) AS open_0915
  FROM x_tr t LEFT JOIN x_atr a USING (symbol, pos) WINDOW w AS (PARTITION BY t.symbol ORDER BY t.pos)""")


def _hm(t: str) -> str:
    return f"strftime(TIMESTAMP '2000-01-01' + to_minutes(CAST({t} AS BIGINT)), '%H:%M')"


for k in SWEEP:
    table(f"x_pivots{k}", f"""
      SELECT symbol, d, type, j, pivot_ts, pivot_t, CASE WHEN close >= open THEN 'green' ELSE 'red' END AS color,
        CASE WHEN type = 'high' THEN greatest(open, close) ELSE least(open, close) END AS body_extreme,
        CASE WHEN type = 'high' THEN high ELSE low END AS wick,
        CASE WHEN type = 'high' THEN least(open, close) ELSE greatest(open, close) END AS body_stop, j + {k} AS confirm_j FROM (
        SELECT *, bar_index AS j, ts AS pivot_ts, t AS pivot_t, unnest(CASE WHEN nb = {k} AND na = {k} THEN
            list_concat(CASE WHEN high > hb AND high > ha THEN ['high'] ELSE [] END, CASE WHEN low < lb AND low < la THEN ['low'] ELSE [] END)
          ELSE [] END) AS type FROM (
          SELECT *, count(*) OVER b AS nb, count(*) OVER a AS na, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb,
            min(low) OVER a AS la FROM x_pos
          WINDOW b AS (PARTITION BY symbol, d ORDER BY bar_index ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING),
            a AS (PARTITION BY symbol, d ORDER BY bar_index ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)))""")
    table(f"x_breaks{k}", f"""
      SELECT p.symbol, p.d, CASE WHEN p.type = 'high' THEN 'long' ELSE 'short' END AS direction, p.j, p.body_extreme, p.pivot_t, p.color,
        p.confirm_j, min(b.bar_index) AS bar_index
      FROM (SELECT *, lead(confirm_j) OVER (PARTITION BY symbol, d, type ORDER BY confirm_j) AS next_j FROM x_pivots{k}) p
      JOIN x_pos b ON b.symbol = p.symbol AND b.d = p.d AND b.bar_index >= p.confirm_j AND b.bar_index < coalesce(p.next_j, 1000000)
        AND b.t BETWEEN {to_minutes(START)} AND {to_minutes(END)}
        AND CASE WHEN p.type = 'high' THEN b.close > p.body_extreme ELSE b.close < p.body_extreme END
      GROUP BY ALL""")
    table(f"x_trig{k}", f"""
      SELECT *, abs(entry_price - swing_stop_price_wick) / entry_price AS stop_dist_swing_wick_pct,
        abs(entry_price - swing_stop_price_body) / entry_price AS stop_dist_swing_body_pct,
        abs(entry_price - third_back_stop_price) / entry_price AS stop_dist_thirdback_pct,
        abs(entry_price - bo_candle_stop_price) / entry_price AS stop_dist_bocandle_pct FROM (
        SELECT x.symbol, x.d AS date, x.direction, x.bar_index, b.t AS trigger_t, {_hm('b.t')} AS trigger_time,
          CASE WHEN b.close > b.open_0915 THEN 'above' ELSE 'below' END AS pos_vs_open, b.open_0915, x.body_extreme AS level_price,
          {_hm('x.pivot_t')} AS swing_candle_time, x.color AS swing_candle_color, x.bar_index - x.confirm_j AS bars_since_swing,
          b.open AS bo_open, b.high AS bo_high, b.low AS bo_low, b.close AS bo_close, b.high - b.low AS bo_range, b.close AS entry_price,
          b.atr_prev AS atr_at_entry, b.avg_range_prev AS avg_range_at_entry, (b.high - b.low) / nullif(b.atr_prev, 0) AS atr_ratio,
          (b.high - b.low) / nullif(b.avg_range_prev, 0) AS range_ratio,
          (SELECT arg_max(g.wick, g.confirm_j) FROM x_pivots{k} g WHERE g.symbol = x.symbol AND g.d = x.d AND g.confirm_j <= x.bar_index
             AND g.type = CASE WHEN x.direction = 'long' THEN 'low' ELSE 'high' END) AS swing_stop_price_wick,
          (SELECT arg_max(g.body_stop, g.confirm_j) FROM x_pivots{k} g WHERE g.symbol = x.symbol AND g.d = x.d AND g.confirm_j <= x.bar_index
             AND g.type = CASE WHEN x.direction = 'long' THEN 'low' ELSE 'high' END) AS swing_stop_price_body,
          CASE WHEN x.direction = 'long' THEN b.low_back ELSE b.high_back END AS third_back_stop_price,
          CASE WHEN x.direction = 'long' THEN b.low ELSE b.high END AS bo_candle_stop_price
        FROM x_breaks{k} x JOIN x_ind b ON b.symbol = x.symbol AND b.d = x.d AND b.bar_index = x.bar_index)""")
    table(f"x_prep{k}", f"""
      SELECT *, entry_price + sgn * R_unit * {CFG.target_r} AS target_price, entry_price + sgn * R_unit * {CFG.breakeven_r} AS be_price FROM (
        SELECT *, CASE WHEN qual_stop THEN abs(entry_price - stop_price) END AS R_unit FROM (
        SELECT f.*, coalesce(atr_ratio <= {CFG.huge_mult}, false) AS qual_huge, coalesce(stop_dist_pct <= {CFG.stop_max}, false) AS qual_stop,
          CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END AS sgn,
          CASE WHEN direction = 'long' THEN h.rl >= h.l0 - 1e-9 ELSE h.rh <= h.h0 + 1e-9 END AS filterA_ok,
          CASE WHEN direction = 'long' THEN entry_price > open_0915 ELSE entry_price < open_0915 END AS filterB_ok FROM (
          SELECT *, CASE WHEN src = 'third_back' THEN third_back_stop_price ELSE swing_stop_price_body END AS stop_price,
            CASE WHEN src = 'third_back' THEN stop_dist_thirdback_pct ELSE stop_dist_swing_body_pct END AS stop_dist_pct, src AS stop_source FROM (
            SELECT *, CASE WHEN stop_dist_swing_body_pct IS NULL AND stop_dist_thirdback_pct IS NULL THEN 'none'
              WHEN stop_dist_swing_body_pct IS NULL OR stop_dist_thirdback_pct > stop_dist_swing_body_pct THEN 'third_back'
              ELSE 'swing_body' END AS src FROM x_trig{k})) f
        JOIN (SELECT symbol, d, t, min(low) OVER w AS rl, max(high) OVER w AS rh, first(low) OVER w AS l0, first(high) OVER w AS h0 FROM x_pos
              WINDOW w AS (PARTITION BY symbol, d ORDER BY t ROWS UNBOUNDED PRECEDING)) h
          ON h.symbol = f.symbol AND h.d = f.date AND h.t = f.trigger_t))""")
    for suffix, be in (("", False), ("_be", True)):
        armed = "coalesce(b.t > a.arm, false)" if be else "false"
        table(f"x_res{k}{suffix}", f"""
          SELECT *, CASE WHEN NOT qual_stop THEN NULL WHEN exit_reason = 'target' THEN {CFG.target_r}
              ELSE sgn * (exit_price - entry_price) / nullif(R_unit, 0) END AS realized_R FROM (
            SELECT p.*, CASE WHEN qual_stop THEN CASE WHEN ev IS NULL THEN 'time' WHEN NOT at_stop THEN 'target'
                WHEN ev_armed THEN 'breakeven' ELSE 'stop' END END AS exit_reason,
              CASE WHEN qual_stop THEN CASE WHEN ev IS NULL THEN coalesce(fo, lc, entry_price) WHEN NOT at_stop THEN target_price
                WHEN ev_armed THEN entry_price ELSE stop_price END END AS exit_price,
              CASE WHEN qual_stop THEN {_hm('coalesce(ev, ft, lt, trigger_t)')} END AS exit_time,
              qual_stop AND coalesce(at_stop AND at_target, false) AS tie_stopfirst
            FROM x_prep{k} p LEFT JOIN (
              SELECT symbol, date, direction, trigger_t, min(t) FILTER (WHERE forced) AS ft, arg_min(open, t) FILTER (WHERE forced) AS fo,
                min(t) FILTER (WHERE event) AS ev, arg_min(hs, t) FILTER (WHERE event) AS at_stop, arg_min(ht, t) FILTER (WHERE event) AS at_target,
                arg_min(armed, t) FILTER (WHERE event) AS ev_armed, max(t) AS lt, arg_max(close, t) AS lc FROM (
                SELECT *, NOT forced AND (hs OR ht) AS event FROM (
                  SELECT p.symbol, p.date, p.direction, p.trigger_t, b.t, b.open, b.close, b.t >= {to_minutes(CFG.force_close)} AS forced,
                    {armed} AS armed, CASE WHEN p.direction = 'long' THEN b.high >= p.target_price ELSE b.low <= p.target_price END AS ht,
                    CASE WHEN p.direction = 'long' THEN b.low <= CASE WHEN {armed} THEN p.entry_price ELSE p.stop_price END
                      ELSE b.high >= CASE WHEN {armed} THEN p.entry_price ELSE p.stop_price END END AS hs
                  FROM x_prep{k} p JOIN x_pos b ON b.symbol = p.symbol AND b.d = p.date AND b.t > p.trigger_t
                  LEFT JOIN (SELECT p.symbol, p.date, p.direction, p.trigger_t, min(b.t) AS arm FROM x_prep{k} p
                    JOIN x_pos b ON b.symbol = p.symbol AND b.d = p.date AND b.t > p.trigger_t
                      AND CASE WHEN p.direction = 'long' THEN b.high >= p.be_price ELSE b.low <= p.be_price END GROUP BY ALL) a
                    ON a.symbol = p.symbol AND a.date = p.date AND a.direction = p.direction AND a.trigger_t = p.trigger_t
                  WHERE p.qual_stop)) GROUP BY 1, 2, 3, 4) r USING (symbol, date, direction, trigger_t))""")
    table(f"x_roll{k}", f"""
      SELECT *, rank_at_cp < 99 AS rolling_ok FROM (
        SELECT t.*, coalesce(b.r_rank, 99) AS rank_at_cp FROM (
          SELECT *, (SELECT max(c) FROM (SELECT unnest([{', '.join(repr(c) for c in CPS)}]) AS c) WHERE c <= trigger_time) AS gov_checkpoint
          FROM x_res{k}_be) t
        LEFT JOIN x_ranked b ON b.date = t.date AND b.checkpoint = t.gov_checkpoint AND b.symbol = t.symbol AND b.r_rank <= {SIZE})""")

table("x_lock", f"SELECT date, symbol, r_rank FROM x_ranked WHERE checkpoint = '{LOCK}' AND r_rank <= {SIZE}")
table("x_enriched", "SELECT r.*, l.r_rank FROM x_res1 r JOIN x_lock l USING (date, symbol)")
table("x_logs", " UNION ALL ".join(
    f"""SELECT *, '{v}' AS filter FROM x_enriched WHERE qual_huge AND qual_stop AND filter{v}_ok
    QUALIFY row_number() OVER (PARTITION BY date ORDER BY trigger_t, r_rank, symbol, direction) = 1""" for v in ("A", "B")))
table("x_sweep", " UNION ALL ".join(
    f"""SELECT *, 'K{k}' AS filter FROM x_roll{k} WHERE qual_huge AND qual_stop AND filterA_ok AND rolling_ok
    QUALIFY row_number() OVER (PARTITION BY date ORDER BY trigger_t, rank_at_cp, symbol, direction) = 1""" for k in SWEEP))


def metrics_sql(log: str, days: str) -> str:
    return f"""
      SELECT h.*, {days} - n_trades AS no_trade_days, d.max_drawdown_R, d.max_dd_duration_trades, s.longest_losing_streak FROM (
        SELECT filter, count(*) AS n_trades, avg(realized_R) AS expectancy_R, sum(realized_R) AS total_R,
          count(*) FILTER (WHERE realized_R > 0) / count(*) AS win_rate, coalesce(avg(realized_R) FILTER (WHERE realized_R > 0), 0) AS avg_win_R,
          coalesce(avg(realized_R) FILTER (WHERE realized_R < 0), 0) AS avg_loss_R,
          count(*) FILTER (WHERE exit_reason = 'target') / count(*) AS pct_target, count(*) FILTER (WHERE exit_reason = 'stop') / count(*) AS pct_stop,
          count(*) FILTER (WHERE exit_reason = 'breakeven') / count(*) AS pct_breakeven, count(*) FILTER (WHERE exit_reason = 'time') / count(*) AS pct_time,
          count(*) FILTER (WHERE exit_reason = 'breakeven') AS n_breakeven, avg(realized_R) FILTER (WHERE exit_reason = 'time') AS time_close_mean_R,
          avg(stop_dist_pct) AS avg_stop_dist_pct, count(*) FILTER (WHERE direction = 'long') AS n_long,
          count(*) FILTER (WHERE direction = 'short') AS n_short, count(*) FILTER (WHERE tie_stopfirst) AS n_tie_stopfirst FROM {log} GROUP BY 1) h
      JOIN (SELECT filter, max(dd) AS max_drawdown_R, greatest(arg_max(i - pi, (dd, -i)), 0) AS max_dd_duration_trades FROM (
          SELECT *, min(i) OVER (PARTITION BY filter, peak) AS pi, peak - eq AS dd FROM (SELECT *, max(eq) OVER w AS peak FROM (
            SELECT filter, date, sum(realized_R) OVER w AS eq, row_number() OVER (PARTITION BY filter ORDER BY date) AS i FROM {log}
            WINDOW w AS (PARTITION BY filter ORDER BY date ROWS UNBOUNDED PRECEDING))
          WINDOW w AS (PARTITION BY filter ORDER BY date ROWS UNBOUNDED PRECEDING))) GROUP BY 1) d USING (filter)
      JOIN (SELECT filter, max(CASE WHEN c THEN n ELSE 0 END) AS longest_losing_streak FROM (SELECT filter, c, g, count(*) AS n FROM (
          SELECT filter, c, row_number() OVER (PARTITION BY filter ORDER BY date) - row_number() OVER (PARTITION BY filter, c ORDER BY date) AS g
          FROM (SELECT filter, date, realized_R < 0 AS c FROM {log})) GROUP BY 1, 2, 3) GROUP BY 1) s USING (filter)"""


table("x_metrics", metrics_sql("x_logs", "(SELECT count(DISTINCT date) FROM x_lock)"))
table("x_kmetrics", metrics_sql("x_sweep", f"(SELECT count(DISTINCT date) FROM x_ranked WHERE r_rank <= {SIZE})"))


def measured(fx):
    return G.indicators(fx.bars_intraday, PERIOD, BACK)


def found(fx, k=1):
    return G.triggers(measured(fx), [k], START, END)


def prepared(fx, k=1):
    return TR.prepare(found(fx, k), fx.bars_intraday, CFG)


def basket(fx):
    return G.locked_basket(long_rows(fx), LOCK, SIZE)


def rolling(fx):
    return G.rolling_basket(long_rows(fx), CPS, SIZE)


def enriched(fx):
    return TR.resolve(TR.prepare(G.basket_triggers(found(fx), basket(fx)), fx.bars_intraday, CFG), fx.bars_intraday, CFG)


def both_logs(fx):
    return TR.select_trades(enriched(fx), ("A", "B"))


def sweep(fx):
    """All fractal widths in one pass over the bars."""
    ready = TR.prepare(G.triggers(measured(fx), SWEEP, START, END), fx.bars_intraday, CFG)
    resolved = TR.resolve(ready, fx.bars_intraday, CFG, breakeven=True)
    chosen = TR.select_rolling(TR.with_governing_rank(resolved, rolling(fx), CPS), ["k"])
    return chosen.withColumn("filter", F.concat(F.lit("K"), F.col("k").cast("string")))


_IND = "symbol ts:t"
_STOPS = ("swing_stop_price_wick:r swing_stop_price_body:r third_back_stop_price:r bo_candle_stop_price:r stop_dist_swing_wick_pct:r7 "
          "stop_dist_swing_body_pct:r7 stop_dist_thirdback_pct:r7 stop_dist_bocandle_pct:r7")
_TRIG = ("date:d trigger_time symbol direction pos_vs_open open_0915:r level_price:r swing_candle_time swing_candle_color "
         "bars_since_swing:i bo_open:r bo_high:r bo_low:r bo_close:r bo_range:r entry_price:r atr_at_entry:r avg_range_at_entry:r "
         "atr_ratio:r range_ratio:r " + _STOPS)
_PREP = "date:d symbol direction trigger_time"
_RES = ("date:d symbol direction trigger_time entry_price:r level_price:r atr_ratio:r pos_vs_open stop_price:r stop_source stop_dist_pct:r "
        "qual_huge:b qual_stop:b filterA_ok:b filterB_ok:b R_unit:r target_price:r exit_time exit_price:r exit_reason realized_R:r tie_stopfirst:b")


@query("geo01_true_range", f"{_IND} tr:r", "SELECT * FROM x_ind")
def _(fx):
    return measured(fx)


@query("geo02_wilder_atr", f"{_IND} atr:r", "SELECT * FROM x_ind")
def _(fx):
    return measured(fx)


@query("geo03_avg_range", f"{_IND} avg_range:r", "SELECT * FROM x_ind")
def _(fx):
    return measured(fx)


@query("geo04_fractal_pivots", "symbol d:d type j:i pivot_ts:t color body_extreme:r wick:r body_stop:r confirm_j:i", "SELECT * FROM x_pivots2")
def _(fx):
    from barlab.functions.chunks import with_position

    return G.fractal_pivots(with_position(fx.bars_intraday), 2)


@query("geo05_level_breaks", "symbol date:d direction bar_index:i level_price:r",
       "SELECT symbol, d AS date, direction, bar_index, body_extreme AS level_price FROM x_breaks2")
def _(fx):
    return found(fx, 2)


@query("jon11_first_break_interval", "symbol date:d direction bar_index:i level_price:r",
       "SELECT symbol, d AS date, direction, bar_index, body_extreme AS level_price FROM x_breaks3")
def _(fx):
    return found(fx, 3)


@query("geo06_trigger_measures", _TRIG, "SELECT * FROM x_trig1")
def _(fx):
    return found(fx)


@query("geo07_locked_basket", "date:d symbol r_rank:i", "SELECT * FROM x_lock")
def _(fx):
    return basket(fx)


@query("geo08_rolling_basket", "date:d checkpoint symbol rank_at_cp:i",
       f"SELECT date, checkpoint, symbol, r_rank AS rank_at_cp FROM x_ranked WHERE r_rank <= {SIZE}")
def _(fx):
    return rolling(fx)


_METRICS6 = [*G.HUGE_METRICS, *G.STOP_METRICS]
_P8 = [round(p * 100) for p in G.PERCENTS]


@query("geo09_trigger_distributions", "metric n:i mean:r std:r " + " ".join(f"p{p}:r" for p in _P8),
       "SELECT metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, " + ", ".join(f"quantile_cont(v, {p / 100}) AS p{p}" for p in _P8)
       + f" FROM (SELECT unnest([{', '.join(repr(m) for m in _METRICS6)}]) AS metric, unnest([{', '.join(_METRICS6)}]) AS v FROM x_trig1) GROUP BY 1")
def _(fx):
    return G.trigger_distributions(found(fx))


@query("geo09_huge_readoff", "metric median:r p75:r p90:r p95:r pct_over_1x:r pct_over_1_5x:r pct_over_2x:r",
       """SELECT metric, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95,
          avg(CASE WHEN v > 1 THEN 1.0 ELSE 0 END) AS pct_over_1x, avg(CASE WHEN v > 1.5 THEN 1.0 ELSE 0 END) AS pct_over_1_5x,
          avg(CASE WHEN v > 2 THEN 1.0 ELSE 0 END) AS pct_over_2x FROM (SELECT unnest(['atr_ratio', 'range_ratio']) AS metric,
            unnest([atr_ratio, range_ratio]) AS v FROM x_trig1) WHERE v IS NOT NULL GROUP BY 1""")
def _(fx):
    return G.huge_readoff(found(fx))


@query("geo09_trigger_sanity", "n_triggers:i per_day_mean:r per_day_median:r per_day_max:i days_with_trigger:i n_test_days:i pct_days_with_trigger:r "
       "long:i short:i long_above:i long_below:i short_above:i short_below:i",
       """SELECT *, days_with_trigger / n_test_days * 100 AS pct_days_with_trigger FROM (SELECT count(*) AS n_triggers,
            count(*) FILTER (WHERE direction = 'long') AS long, count(*) FILTER (WHERE direction = 'short') AS short,
            count(*) FILTER (WHERE direction = 'long' AND pos_vs_open = 'above') AS long_above,
            count(*) FILTER (WHERE direction = 'long' AND pos_vs_open = 'below') AS long_below,
            count(*) FILTER (WHERE direction = 'short' AND pos_vs_open = 'above') AS short_above,
            count(*) FILTER (WHERE direction = 'short' AND pos_vs_open = 'below') AS short_below FROM x_trig1),
          (SELECT avg(n) AS per_day_mean, quantile_cont(n, 0.5) AS per_day_median, max(n) AS per_day_max, count(*) AS days_with_trigger
           FROM (SELECT date, count(*) AS n FROM x_trig1 GROUP BY 1)), (SELECT count(DISTINCT d) AS n_test_days FROM x_hours)""")
def _(fx):
    return G.trigger_sanity(found(fx), fx.bars_intraday.agg(F.count_distinct("d")).scalar())


@query("geo09_audit_extremes", "date:d symbol direction trigger_time atr_ratio:r",
       "SELECT * FROM x_trig1 WHERE atr_ratio IS NOT NULL ORDER BY atr_ratio DESC, date, symbol, direction, trigger_t LIMIT 25")
def _(fx):
    return G.audit_sample(found(fx), 25, 25).where("audit_bucket = 'extreme_huge'")


@query("geo09_audit_sample", "audit_bucket date:d symbol direction trigger_time atr_ratio:r")
def _(fx):
    return G.audit_sample(found(fx), 25, 25)


@query("trd01_choose_stop", f"{_PREP} stop_price:r stop_dist_pct:r stop_source", "SELECT * FROM x_prep1")
def _(fx):
    return TR.choose_stop(found(fx))


@query("trd02_momentum_filters", f"{_PREP} filterA_ok:b filterB_ok:b", "SELECT * FROM x_prep1")
def _(fx):
    return TR.momentum_filters(found(fx), fx.bars_intraday)


@query("trd03_qualifiers", f"{_PREP} qual_huge:b qual_stop:b", "SELECT * FROM x_prep1")
def _(fx):
    return TR.qualifiers(TR.choose_stop(found(fx)), CFG)


@query("trd04_targets", f"{_PREP} R_unit:r target_price:r be_price:r", "SELECT * FROM x_prep1")
def _(fx):
    return prepared(fx)


@query("trd05_first_touch", _RES, "SELECT * FROM x_res1")
def _(fx):
    return TR.resolve(prepared(fx), fx.bars_intraday, CFG)


@query("jon12_forward_barrier", f"{_PREP} exit_time exit_reason", "SELECT * FROM x_res2")
def _(fx):
    return TR.resolve(prepared(fx, 2), fx.bars_intraday, CFG)


@query("trd06_first_touch_breakeven", _RES + " be_price:r", "SELECT * FROM x_res1_be")
def _(fx):
    return TR.resolve(prepared(fx), fx.bars_intraday, CFG, breakeven=True)


@query("trd07_select_trades", f"filter r_rank:i {_RES}", "SELECT * FROM x_logs")
def _(fx):
    return both_logs(fx)


@query("trd08_select_rolling", "filter date:d symbol direction trigger_time gov_checkpoint rank_at_cp:i rolling_ok:b exit_reason realized_R:r",
       "SELECT * FROM x_sweep")
def _(fx):
    return sweep(fx)


_INT = {"n_trades", "no_trade_days", "n_breakeven", "max_dd_duration_trades", "longest_losing_streak", "n_long", "n_short", "n_tie_stopfirst"}
_MET = "filter " + " ".join(f"{m}:{'i' if m in _INT else 'r'}" for m in TR.METRICS)


def metrics(fx):
    fx = fx.by_day()
    leaders = materialise(basket(fx), "basket")
    days = leaders.agg(F.count_distinct("date")).scalar()
    ready = TR.prepare(G.basket_triggers(found(fx), leaders), fx.bars_intraday, CFG)
    log = TR.select_trades(TR.resolve(ready, fx.bars_intraday, CFG), ("A", "B"))
    return TR.trade_metrics(log, "filter", days)


def sweep_metrics(fx):
    days = rolling(fx).agg(F.count_distinct("date")).scalar()
    return TR.trade_metrics(sweep(fx), "filter", days)


@query("trd09_trade_metrics", _MET, "SELECT * FROM x_metrics")
def _(fx):
    return metrics(fx)


@query("trd10_compare_filters", "metric A:r B:r",
       "SELECT metric, max(v) FILTER (WHERE filter = 'A') AS \"A\", max(v) FILTER (WHERE filter = 'B') AS \"B\" FROM (SELECT filter, "
       + f"unnest([{', '.join(repr(m) for m in TR.METRICS)}]) AS metric, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in TR.METRICS)}]) AS v "
       + "FROM x_metrics) GROUP BY 1")
def _(fx):
    return TR.compare_variants(metrics(fx), "filter", ["A", "B"])


@query("trd10_sweep_metrics", _MET, "SELECT * FROM x_kmetrics")
def _(fx):
    return sweep_metrics(fx)


@query("trd10_best_variant", "best expectancy_R:r",
       "SELECT filter AS best, expectancy_R FROM x_kmetrics ORDER BY expectancy_R DESC, filter DESC LIMIT 1")
def _(fx):
    return TR.best_variant(sweep_metrics(fx), "filter")


@query("trd11_trade_log", "filter date:d symbol trigger_time result exit_reason",
       """SELECT *, CASE WHEN realized_R > 0 THEN 'win' WHEN realized_R < 0 THEN 'loss' ELSE '' END AS result FROM (
            SELECT filter, date, symbol, trigger_time, exit_reason, realized_R FROM x_logs UNION ALL
            SELECT filter, date, symbol, trigger_time, exit_reason, realized_R FROM x_sweep)""")
def _(fx):
    return TR.trade_log([both_logs(fx), sweep(fx)])
