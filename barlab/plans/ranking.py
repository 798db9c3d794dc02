"""Queries for the relative-volume ranking, relative strength and selection lift."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions.scalars import label, to_minutes
from barlab.operators import rvol as R
from barlab.operators import strength as ST
from barlab.operators.joins import exclusive
from barlab.plans.registry import query
from barlab.plans.relational import CPS, cp_sql
from barlab.plans.sql_base import table
from barlab.sources import bars as B

C = F.col
CFG = R.RankingConfig(
    checkpoints=tuple(CPS), top_n=3, top_subset=2, lookback=5, move_threshold=4.0, capture_bar=0.5, min_bars=4,
    close_after="15:00",
)
LABELS = [label(c) for c in CPS]
MINUTES = [to_minutes(c) for c in CPS]

table("x_opened", "SELECT *, first(open) OVER (PARTITION BY symbol, d ORDER BY t) AS o0 FROM x_hours")
table("x_symdays", f"""
  SELECT symbol, d, arg_min(open, t) AS open_0915, max(high) AS day_high, min(low) AS day_low, arg_max(close, t) AS session_close,
    count(*) AS n_candles, min(t) AS first_t, max(t) AS last_t, {cp_sql()},
    min(t) FILTER (WHERE high >= o0 * (1 + {CFG.move_threshold}) OR low <= o0 * (1 - {CFG.move_threshold})) AS time_first_hit
  FROM x_opened GROUP BY 1, 2""")
table("x_normal", f"""
  SELECT * REPLACE ({', '.join(f'CASE WHEN normal_session THEN coalesce(cv_{m}, 0) ELSE cv_{m} END AS cv_{m}' for m in LABELS)})
  FROM (SELECT *, open_0915 IS NOT NULL AND n_candles >= {CFG.min_bars} AND last_t >= {to_minutes(CFG.close_after)} AS normal_session
        FROM x_symdays)""")
table("x_base", f"""
  SELECT symbol, d, {', '.join(f'CASE WHEN count(*) OVER w = {CFG.lookback} THEN avg(cv_{m}) OVER w END AS base_{m}' for m in LABELS)}
  FROM x_normal WHERE normal_session
  WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN {CFG.lookback} PRECEDING AND 1 PRECEDING)""")
table("x_dirty", f"""
  SELECT DISTINCT b.symbol, b.d FROM (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM x_symdays) b
  JOIN (SELECT c.symbol, c.ex_date, min(k.n) AS n, min(k.d) = c.ex_date AS exact FROM x_corp c
    JOIN (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS n FROM x_symdays) k
      ON k.symbol = c.symbol AND k.d >= c.ex_date GROUP BY c.symbol, c.ex_date) p ON p.symbol = b.symbol
    AND b.n BETWEEN p.n AND p.n + CASE WHEN p.exact THEN {CFG.lookback} ELSE {CFG.lookback} - 1 END""")
table("x_rdays", f"""
  SELECT *, CASE WHEN up AND dn THEN 'both' WHEN up THEN 'up' WHEN dn THEN 'down' ELSE 'none' END AS hit_direction,
    up OR dn AS hit_2pct FROM (
    SELECT n.* RENAME (d AS date), {', '.join(f'b.base_{m}, n.cv_{m} / nullif(b.base_{m}, 0) AS r_{m}' for m in LABELS)},
      (n.symbol, n.d) IN (SELECT (symbol, d) FROM x_dirty) AS corp_contaminated,
      normal_session AND b.base_{LABELS[0]} IS NOT NULL AND (n.symbol, n.d) NOT IN (SELECT (symbol, d) FROM x_dirty) AS eligible,
      (day_high - open_0915) / open_0915 AS max_up_pct, (open_0915 - day_low) / open_0915 AS max_down_pct,
      (day_high - open_0915) / open_0915 >= {CFG.move_threshold} AS up, (open_0915 - day_low) / open_0915 >= {CFG.move_threshold} AS dn
    FROM x_normal n LEFT JOIN x_base b USING (symbol, d))""")
table("x_long", f"""
  SELECT *, coalesce(fav_move_after_cp_pct >= {CFG.capture_bar}, false) AS capturable FROM (
    SELECT *, CASE WHEN price_at_checkpoint >= open_0915 THEN 'up' ELSE 'down' END AS direction_at_checkpoint,
      CASE WHEN price_at_checkpoint >= open_0915 THEN hi_after - price_at_checkpoint ELSE price_at_checkpoint - lo_after END
        / nullif(price_at_checkpoint, 0) AS fav_move_after_cp_pct FROM (""" + " UNION ALL ".join(
    f"""SELECT date, symbol, open_0915, session_close AS close, max_up_pct, max_down_pct, hit_2pct, hit_direction, time_first_hit,
      eligible, '{c}' AS checkpoint, {i} AS step, cv_{m} AS cv, base_{m} AS baseline, r_{m} AS r_factor,
      px_{m} AS price_at_checkpoint, hi_after_{m} AS hi_after, lo_after_{m} AS lo_after FROM x_rdays"""
    for i, (c, m) in enumerate(zip(CPS, LABELS))) + "))")
table("x_ranked", """
  SELECT *, row_number() OVER (PARTITION BY date, checkpoint ORDER BY r_factor DESC, symbol) AS r_rank
  FROM x_long WHERE eligible AND r_factor IS NOT NULL""")
table("x_picks", f"SELECT *, r_rank <= {CFG.top_subset} AS in_top5 FROM x_ranked WHERE r_rank <= {CFG.top_n}")


def days(fx):
    return R.day_table(fx.bars_intraday, fx.corp_actions, CFG)


def long_rows(fx):
    return R.checkpoint_rows(days(fx), CFG)


def picks(fx):
    return R.picks(long_rows(fx), CFG)


_AGG = ("symbol d:d open_0915:r day_high:r day_low:r session_close:r n_candles:i first_t:i last_t:i time_first_hit:i "
        + " ".join(f"cv_{m}:i px_{m}:r hi_after_{m}:r lo_after_{m}:r" for m in LABELS))
_PICKS = ("date:d checkpoint symbol r_rank:i in_top5:b r_factor:r cv:i baseline:r open_0915:r price_at_checkpoint:r "
          "direction_at_checkpoint max_up_pct:r max_down_pct:r hit_2pct:b hit_direction time_first_hit:i "
          "fav_move_after_cp_pct:r capturable:b close:r")


@query("rfa01_trading_calendar", "d:d", "SELECT DISTINCT d FROM x_hours WHERE symbol = 'S0'")
def _(fx):
    return R.trading_calendar(fx.bars_intraday, "S0")


@query("rfa02_symbol_days", _AGG, "SELECT * FROM x_symdays")
def _(fx):
    return R.symbol_days(fx.bars_intraday, CPS, CFG.move_threshold)


@query("rfa03_normal_session", "symbol date:d n_candles:i last_t:i normal_session:b", "SELECT * FROM x_rdays")
def _(fx):
    return days(fx)


@query("rfa04_r_factor", "symbol date:d " + " ".join(f"cv_{m}:i base_{m}:r r_{m}:r" for m in LABELS), "SELECT * FROM x_rdays")
def _(fx):
    return days(fx)


@query("rfa05_eligible", "symbol date:d corp_contaminated:b eligible:b", "SELECT * FROM x_rdays")
def _(fx):
    return days(fx)


@query("rfa06_day_outcomes", "symbol date:d max_up_pct:r max_down_pct:r hit_2pct:b hit_direction", "SELECT * FROM x_rdays")
def _(fx):
    return days(fx)


@query("rfa07_rank_checkpoint", "date:d checkpoint symbol r_factor:r r_rank:i",
       "SELECT l.*, r.r_rank FROM x_long l LEFT JOIN x_ranked r USING (date, checkpoint, symbol)")
def _(fx):
    return R.with_rank(long_rows(fx))


@query("rfa08_capture_block", "date:d checkpoint symbol price_at_checkpoint:r direction_at_checkpoint fav_move_after_cp_pct:r capturable:b",
       "SELECT * FROM x_long")
def _(fx):
    return long_rows(fx)


@query("rfa09_picks", _PICKS, "SELECT * FROM x_picks")
def _(fx):
    return picks(fx)


@query("rfa10_degenerate_days", "date:d n_eligible:i",
       """SELECT date, count(*) FILTER (WHERE eligible) AS n_eligible FROM x_rdays GROUP BY 1
          HAVING count(*) FILTER (WHERE eligible) < 0.5 * (SELECT count(DISTINCT symbol) FROM x_hours)""")
def _(fx):
    size = fx.universe.agg(F.count(F.lit(1))).scalar()
    return R.degenerate_days(days(fx), size, CFG)


@query("rfa11_base_rate", "base_rate:r", "SELECT avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) AS base_rate FROM x_rdays WHERE eligible")
def _(fx):
    return R.base_rate(days(fx))


table("x_rate", "SELECT avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) AS base_rate FROM x_rdays WHERE eligible")
table("x_hitcurve", """
  SELECT *, topn_hit - base_rate AS lift_topn, top5_hit - base_rate AS lift_top5 FROM (
    SELECT checkpoint, count(*) AS n_picks, avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) AS topn_hit,
      avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) FILTER (WHERE in_top5) AS top5_hit, (SELECT base_rate FROM x_rate) AS base_rate
    FROM x_picks GROUP BY 1)""")
table("x_capcurve", """
  SELECT checkpoint, quantile_cont(fav_move_after_cp_pct, 0.5) AS median_fav_move, avg(fav_move_after_cp_pct) AS mean_fav_move,
    avg(CASE WHEN capturable THEN 1.0 ELSE 0.0 END) AS pct_capturable FROM x_picks GROUP BY 1""")
table("x_churn", """
  SELECT checkpoint, next_checkpoint, avg(p) AS persistence, 1 - avg(p) AS churn FROM (
    SELECT a.date, a.checkpoint, n.checkpoint AS next_checkpoint, avg(CASE WHEN b.symbol IS NULL THEN 0.0 ELSE 1.0 END) AS p
    FROM x_picks a JOIN (SELECT DISTINCT step, checkpoint FROM x_long) n ON n.step = a.step + 1
    LEFT JOIN x_picks b ON b.date = a.date AND b.symbol = a.symbol AND b.step = a.step + 1 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
table("x_perday", "SELECT date, checkpoint, count(*) FILTER (WHERE hit_2pct) AS n_hits, count(*) AS n_picks FROM x_picks GROUP BY 1, 2")

_CURVE = "checkpoint n_picks:i topn_hit:r top5_hit:r base_rate:r lift_topn:r lift_top5:r"


@query("rfa12_hit_rate_curve", _CURVE, "SELECT * FROM x_hitcurve")
def _(fx):
    return R.hit_rate_curve(picks(fx), days(fx))


@query("rfa13_capturable_curve", "checkpoint median_fav_move:r mean_fav_move:r pct_capturable:r", "SELECT * FROM x_capcurve")
def _(fx):
    return R.capturable_curve(picks(fx))


@query("rfa14_churn_curve", "checkpoint next_checkpoint persistence:r churn:r", "SELECT * FROM x_churn")
def _(fx):
    return R.churn_curve(picks(fx), CFG)


@query("rfa15_picks_per_day", "date:d checkpoint n_hits:i n_picks:i", "SELECT * FROM x_perday")
def _(fx):
    return R.picks_per_day(picks(fx))


@query("rfa16_direction_split", "checkpoint n_hits:i pct_up:r pct_down:r pct_both:r",
       "SELECT checkpoint, count(*) FILTER (WHERE hit_2pct) AS n_hits, " + ", ".join(
           f"avg(CASE WHEN hit_direction = '{d}' THEN 1.0 ELSE 0.0 END) FILTER (WHERE hit_2pct) AS pct_{d}" for d in ("up", "down", "both"))
       + " FROM x_picks GROUP BY 1")
def _(fx):
    return R.direction_split(picks(fx))


_MAG = {"pct_ge_2": 0.5, "pct_ge_3": 1.0, "pct_ge_5": 2.0}


@query("rfa17_magnitude", "checkpoint pct_ge_2:r pct_ge_3:r pct_ge_5:r median_abs_move:r",
       "SELECT checkpoint, " + ", ".join(f"avg(CASE WHEN m >= {t} THEN 1.0 ELSE 0.0 END) AS {n}" for n, t in _MAG.items())
       + ", quantile_cont(m, 0.5) AS median_abs_move FROM (SELECT *, greatest(max_up_pct, max_down_pct) AS m FROM x_picks) GROUP BY 1")
def _(fx):
    return R.magnitude_distribution(picks(fx), _MAG)


@query("rfa18_verdict_summary", _CURVE + " median_fav_move:r pct_capturable:r mean_picks_hit:r churn:r",
       """SELECT h.*, c.median_fav_move, c.pct_capturable, p.mean_picks_hit, k.churn FROM x_hitcurve h LEFT JOIN x_capcurve c USING (checkpoint)
          LEFT JOIN (SELECT checkpoint, avg(n_hits) AS mean_picks_hit FROM x_perday GROUP BY 1) p USING (checkpoint)
          LEFT JOIN x_churn k USING (checkpoint)""")
def _(fx):
    return R.verdict_summary(picks(fx), days(fx), CFG)


@query("rfa19_leaderboard", "date:d checkpoint r_rank:i symbol r_factor:r cv:i baseline:r in_basket:b",
       "SELECT *, r_rank <= 2 AS in_basket FROM x_ranked WHERE r_rank <= 4")
def _(fx):
    return R.leaderboard(long_rows(fx), 4, 2)


@query("rfa19_day_grid", "date:d checkpoint rank_1 rank_2 rank_3 rank_4",
       "SELECT date, checkpoint, " + ", ".join(f"max(symbol) FILTER (WHERE r_rank = {i}) AS rank_{i}" for i in range(1, 5))
       + " FROM x_ranked WHERE r_rank <= 4 GROUP BY 1, 2")
def _(fx):
    return R.day_grid(R.leaderboard(long_rows(fx), 4, 2), 4)


# relative strength

table("x_moves", """
  SELECT symbol, ts, d, t, (close - o0) / o0 AS move FROM x_opened WHERE o0 <> 0""")
table("x_bmoves", """
  SELECT benchmark_index, ts, (close - o0) / o0 AS move FROM (
    SELECT *, first(open) OVER (PARTITION BY benchmark_index, d ORDER BY t) AS o0 FROM x_bench) WHERE o0 <> 0""")
table("x_rs", """
  SELECT s.symbol, s.ts, s.d, s.t, m.membership_type, m.benchmark_index, s.move - b.move AS rs_value, '60min' AS timeframe
  FROM x_moves s JOIN x_members m USING (symbol) JOIN x_bmoves b ON b.benchmark_index = m.benchmark_index AND b.ts = s.ts""")
table("x_rscp", "SELECT symbol, d, " + ", ".join(
    f"max(rs_value) FILTER (WHERE t <= {v} AND membership_type = 'sector') AS rs_sect_{m}, "
    f"avg(rs_value) FILTER (WHERE t <= {v} AND membership_type = 'broad') AS rs_mkt_{m}" for m, v in zip(LABELS, MINUTES))
    + " FROM x_rs GROUP BY 1, 2")
table("x_held", "SELECT symbol, d, " + ", ".join(
    f"coalesce(lo_{m} >= l0 - 1e-9, false) AS fa_long_{m}, coalesce(hi_{m} <= h0 + 1e-9, false) AS fa_short_{m}" for m in LABELS)
    + " FROM (SELECT symbol, d, min(low) FILTER (WHERE t = 0) AS l0, max(high) FILTER (WHERE t = 0) AS h0, " + ", ".join(
    f"min(low) FILTER (WHERE t <= {v}) AS lo_{m}, max(high) FILTER (WHERE t <= {v}) AS hi_{m}" for m, v in zip(LABELS, MINUTES))
    + " FROM x_hours GROUP BY 1, 2) WHERE l0 IS NOT NULL")
table("x_eval", " UNION ALL ".join(
    f"""SELECT p.*, r.rs_sect_{m} AS RS_sector, r.rs_mkt_{m} AS RS_market,
      CASE WHEN p.direction_at_checkpoint = 'up' THEN f.fa_long_{m} ELSE f.fa_short_{m} END AS filterA_ok
    FROM x_picks p LEFT JOIN x_rscp r ON r.symbol = p.symbol AND r.d = p.date LEFT JOIN x_held f ON f.symbol = p.symbol AND f.d = p.date
    WHERE p.checkpoint = '{c}'""" for c, m in zip(CPS, LABELS)))

# Per method: (condition, descending key or None, rows needed), first option with enough rows wins.
_ALL = ("true", None, 1)
_OPTIONS = {
    "B0_R_alone": [_ALL],
    "B1_R_filterA": [("filterA_ok", None, 1), _ALL],
    "S3_both_filter": [("RS_sector > 0 AND RS_market > 0", None, 3), ("RS_sector > 0 OR RS_market > 0", None, 1), _ALL],
    "S3_both_rank": [("RS_sector IS NOT NULL OR RS_market IS NOT NULL", "coalesce(RS_sector, 0) + coalesce(RS_market, 0)", 1), _ALL],
}
for _p, _n in (("S1", "sector"), ("S2", "market")):
    _x = f"RS_{_n}"
    _OPTIONS |= {
        f"{_p}_{_n}_filter": [(f"{_x} > 0", None, 1), (f"{_x} IS NOT NULL", None, 1), _ALL],
        f"{_p}_{_n}_rank": [(f"{_x} IS NOT NULL", _x, 1), _ALL],
        f"{_p}_{_n}_abs_rank": [(f"{_x} IS NOT NULL", f"abs({_x})", 1), _ALL],
        f"S4_filterA_{_n}RS": [(f"filterA_ok AND {_x} IS NOT NULL", _x, 1), ("filterA_ok", None, 1), (f"{_x} IS NOT NULL", _x, 1), _ALL],
        f"S5_{_n}RS_nofilter": [(f"{_x} IS NOT NULL", _x, 1), _ALL],
    }
table("x_offers", " UNION ALL ".join(
    f"""SELECT *, '{method}' AS method, {i} AS opt, CAST({'0' if key is None else f'-({key})'} AS DOUBLE) AS score, {need} AS need
    FROM x_eval WHERE {cond}""" for method, opts in _OPTIONS.items() for i, (cond, key, need) in enumerate(opts)))
table("x_sel", f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, date, checkpoint ORDER BY score, r_rank) AS pos FROM (
    SELECT *, min(CASE WHEN k >= need THEN opt END) OVER (PARTITION BY method, date, checkpoint) AS best FROM (
      SELECT *, count(*) OVER (PARTITION BY method, date, checkpoint, opt) AS k FROM x_offers)) WHERE opt = best) WHERE pos <= {CFG.top_n}""")
table("x_curves", f"""
  SELECT *, hit_rate - base_rate AS lift, hit_rate_top5 - base_rate AS lift_top5 FROM (
    SELECT method, date, checkpoint, count(*) AS n_picks, avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) AS hit_rate,
      count(*) FILTER (WHERE pos <= {CFG.top_subset}) AS n_picks_top5,
      avg(CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos <= {CFG.top_subset}) AS hit_rate_top5,
      (SELECT base_rate FROM x_rate) AS base_rate FROM x_sel GROUP BY 1, 2, 3)""")
table("x_lift", """
  SELECT a.*, a.lift - b.lift AS lift_delta_vs_B0, a.lift - c.lift AS lift_delta_vs_B1 FROM x_pool a
  LEFT JOIN (SELECT * FROM x_pool WHERE method = 'B0_R_alone') b USING (checkpoint)
  LEFT JOIN (SELECT * FROM x_pool WHERE method = 'B1_R_filterA') c USING (checkpoint)""")
table("x_pool", """
  SELECT method, checkpoint, sum(n_picks) AS n_total_picks, avg(hit_rate) AS hit_rate, max(base_rate) AS base_rate, avg(lift) AS lift,
    sum(n_picks_top5) AS n_total_top5, avg(hit_rate_top5) AS hit_rate_top5, avg(lift_top5) AS lift_top5 FROM x_curves GROUP BY 1, 2""")


def members(fx):
    return ST.membership_map(fx.constituents, fx.universe, "ALL")


def strength(fx):
    return ST.rs_values(fx.bars_intraday, members(fx), fx.bench_intraday, "60min")


def evaluated(fx):
    top = picks(fx)
    at_cp = ST.rs_at_checkpoints(strength(fx), CPS)
    return ST.eval_frame(top, at_cp, ST.extreme_held(fx.bars_intraday, CPS, "00:00"), CPS)


def selected(fx):
    return ST.select_by_method(evaluated(fx), CFG.top_n)


def curves(fx):
    return ST.method_curves(selected(fx), R.base_rate(days(fx)).scalar(), CFG.top_subset)


_RS = "symbol ts:t membership_type benchmark_index rs_value:r"


@query("rst01_membership_map", "symbol benchmark_index membership_type n_sectors:i no_sector:b",
       """SELECT m.*, s.n AS n_sectors, s.n = 0 AS no_sector FROM x_members m JOIN (
            SELECT symbol, count(*) FILTER (WHERE membership_type = 'sector') AS n FROM x_members GROUP BY 1) s USING (symbol)""")
def _(fx):
    return members(fx).join(ST.sector_profile(members(fx)), "symbol")


@query("rst02_move_from_open", "symbol ts:t move:r", "SELECT * FROM x_moves")
def _(fx):
    return ST.move_from_open(fx.bars_intraday, "symbol")


@query("rst03_rs_values", _RS + " timeframe", "SELECT * FROM x_rs")
def _(fx):
    return strength(fx)


@query("snk02_write_rs", _RS + " timeframe", "SELECT * FROM x_rs")
def _(fx):
    from barlab.session import new_path

    root = new_path(fx.spark, "rs")
    rs = strength(fx)
    # a larger set first: what the second write lacks must be gone
    more = rs.withColumn("benchmark_index", F.concat("benchmark_index", F.lit("-old")))
    B.write_rs(rs.withColumn("rs_value", F.lit(-1.0)).unionByName(more), root)
    B.write_rs(rs, root)
    return B.read_rs(fx.spark, root)


@query("src05_read_rs", "timeframe benchmark_index n:i",
       "SELECT timeframe, benchmark_index, count(*) AS n FROM x_rs GROUP BY 1, 2")
def _(fx):
    from barlab.session import new_path

    root = new_path(fx.spark, "rs")
    B.write_rs(strength(fx), root)
    return B.read_rs(fx.spark, root, "60min").groupBy("timeframe", "benchmark_index").agg(F.count(F.lit(1)).alias("n"))


@query("rst04_rs_counts", "timeframe membership_type benchmark_index rows:i symbols:i first_d:d last_d:d",
       """SELECT timeframe, membership_type, benchmark_index, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(d) AS first_d,
          max(d) AS last_d FROM x_rs GROUP BY 1, 2, 3""")
def _(fx):
    return ST.rs_counts(strength(fx))


@query("rst04_index_coverage", "benchmark_index rows:i first_d:d last_d:d members:i",
       """SELECT b.*, coalesce(m.n, 0) AS members FROM (SELECT benchmark_index, count(*) AS rows, min(d) AS first_d, max(d) AS last_d
          FROM x_bench GROUP BY 1) b LEFT JOIN (SELECT benchmark_index, count(*) AS n FROM x_members GROUP BY 1) m USING (benchmark_index)""")
def _(fx):
    return ST.index_coverage(fx.bench_intraday, members(fx))


_CPCOLS = "symbol d:d " + " ".join(f"rs_sect_{m}:r rs_mkt_{m}:r" for m in LABELS)


@query("rst05_rs_at_checkpoints", _CPCOLS, "SELECT * FROM x_rscp")
def _(fx):
    return ST.rs_at_checkpoints(strength(fx), CPS)


@query("rst06_rs_last_at_checkpoint", _CPCOLS,
       "SELECT symbol, d, " + ", ".join(f"max(v_{m}) FILTER (WHERE membership_type = 'sector') AS rs_sect_{m}, "
                                        f"avg(v_{m}) FILTER (WHERE membership_type = 'broad') AS rs_mkt_{m}" for m in LABELS)
       + " FROM (SELECT symbol, d, membership_type, benchmark_index, " + ", ".join(
           f"arg_max(rs_value, t) FILTER (WHERE t <= {v}) AS v_{m}" for m, v in zip(LABELS, MINUTES)) + " FROM x_rs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def _(fx):
    return ST.rs_last_at_checkpoint(strength(fx), CPS)


_EXACT = """SELECT symbol, d, max(rs_value) FILTER (WHERE membership_type = 'sector') AS RS_sector,
  avg(rs_value) FILTER (WHERE membership_type = 'broad') AS RS_market FROM x_rs WHERE t = 720 GROUP BY 1, 2"""


@query("rst06_rs_exact_at", "symbol d:d RS_sector:r RS_market:r", _EXACT)
def _(fx):
    return ST.rs_exact_at(strength(fx), "12:00")


@query("rst07_extreme_held", "symbol d:d " + " ".join(f"fa_long_{m}:b fa_short_{m}:b" for m in LABELS), "SELECT * FROM x_held")
def _(fx):
    return ST.extreme_held(fx.bars_intraday, CPS, "00:00")


@query("rst08_eval_frame", "date:d checkpoint symbol r_rank:i r_factor:r hit_2pct:b RS_sector:r RS_market:r filterA_ok:b", "SELECT * FROM x_eval")
def _(fx):
    return evaluated(fx)


@query("rst09_selection_methods", "method date:d checkpoint symbol pos:i r_rank:i", "SELECT * FROM x_sel")
def _(fx):
    return selected(fx)


_CUR = "n_picks:i hit_rate:r base_rate:r lift:r n_picks_top5:i hit_rate_top5:r lift_top5:r"


@query("rst10_method_curves", f"method date:d checkpoint {_CUR}", "SELECT * FROM x_curves")
def _(fx):
    return curves(fx)


@query("rst10_best_of_day", "method date:d checkpoint symbol r_rank:i r_factor:r RS_sector:r RS_market:r direction hit_2pct:b max_up_pct:r max_down_pct:r open_0915:r",
       "SELECT *, direction_at_checkpoint AS direction FROM x_sel WHERE pos = 1")
def _(fx):
    return ST.best_of_day(selected(fx))


_LIFT = ("method checkpoint n_total_picks:i hit_rate:r base_rate:r lift:r n_total_top5:i hit_rate_top5:r lift_top5:r "
         "lift_delta_vs_B0:r lift_delta_vs_B1:r")


@query("rst11_lift_summary", _LIFT, "SELECT * FROM x_lift")
def _(fx):
    return ST.lift_summary(curves(fx.by_day()))


@query("rst12_pooled_methods", "method n_total_picks:i hit_rate:r base_rate:r lift:r hit_rate_top5:r lift_top5:r lift_delta_vs_B0:r lift_delta_vs_B1:r",
       """SELECT method, sum(n_total_picks) AS n_total_picks, avg(hit_rate) AS hit_rate, max(base_rate) AS base_rate, avg(lift) AS lift,
          avg(hit_rate_top5) AS hit_rate_top5, avg(lift_top5) AS lift_top5, avg(lift_delta_vs_B0) AS lift_delta_vs_B0,
          avg(lift_delta_vs_B1) AS lift_delta_vs_B1 FROM x_lift GROUP BY 1""")
def _(fx):
    return ST.pooled_methods(ST.lift_summary(curves(fx)))


_SHOWN = ["B0_R_alone", "B1_R_filterA", "S1_sector_filter", "S2_market_filter", "S3_both_filter", "S1_sector_rank", "S2_market_rank", "S3_both_rank"]


@query("rst12_lift_pivot", "checkpoint " + " ".join(f"{m}:r" for m in _SHOWN),
       "SELECT checkpoint, " + ", ".join(f"avg(lift) FILTER (WHERE method = '{m}') AS {m}" for m in _SHOWN) + " FROM x_lift GROUP BY 1")
def _(fx):
    return ST.lift_pivot(ST.lift_summary(curves(fx)), _SHOWN)


@query("rst13_rs_distribution", "membership_type n:i mean:r std:r min:r max:r extreme:i p5:r p25:r p50:r p75:r p95:r",
       """SELECT membership_type, count(*) AS n, avg(rs_value) AS mean, stddev_samp(rs_value) AS std, min(rs_value) AS min, max(rs_value) AS max,
          count(*) FILTER (WHERE abs(rs_value) > 0.5) AS extreme, """ + ", ".join(f"quantile_cont(rs_value, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))
       + " FROM x_rs GROUP BY 1")
def _(fx):
    return ST.rs_distribution(strength(fx))


@query("rst13_rs_alignment", "t:i n:i mean:r std:r",
       "SELECT t, count(*) AS n, avg(rs_value) AS mean, stddev_samp(rs_value) AS std FROM x_rs WHERE membership_type = 'broad' AND t IN (360, 540, 720, 900) GROUP BY 1")
def _(fx):
    return ST.rs_alignment(strength(fx), CPS)


table("x_relev", f"""SELECT d.*, e.RS_sector, e.RS_market, CASE WHEN hit_2pct THEN 1.0 ELSE 0.0 END AS hit FROM x_rdays d
  LEFT JOIN ({_EXACT}) e ON e.symbol = d.symbol AND e.d = d.date WHERE eligible""")


@query("rst13_rs_relevance", "measure n_pos:i pos_hit:r n_neg:i neg_hit:r corr:r base_rate:r pos_lift:r neg_lift:r",
       "SELECT *, pos_hit - base_rate AS pos_lift, neg_hit - base_rate AS neg_lift FROM (" + " UNION ALL ".join(
           f"""SELECT '{m}' AS measure, count(*) FILTER (WHERE {m} > 0) AS n_pos, avg(hit) FILTER (WHERE {m} > 0) AS pos_hit,
           count(*) FILTER (WHERE {m} <= 0) AS n_neg, avg(hit) FILTER (WHERE {m} <= 0) AS neg_hit, covar_pop({m}, hit) / nullif(stddev_pop({m}) * stddev_pop(hit), 0) AS corr,
           (SELECT avg(hit) FROM x_relev) AS base_rate FROM x_relev WHERE {m} IS NOT NULL""" for m in ("RS_sector", "RS_market")) + ")")
def _(fx):
    return ST.rs_relevance(days(fx), ST.rs_exact_at(strength(fx), "12:00"))


@query("rst13_rs_quartiles", "bin:i n:i hit_rate:r",
       """SELECT CASE WHEN RS_market <= q[1] THEN 1 WHEN RS_market <= q[2] THEN 2 WHEN RS_market <= q[3] THEN 3 ELSE 4 END AS bin,
          count(*) AS n, avg(hit) AS hit_rate FROM x_relev, (SELECT quantile_cont(RS_market, [0.25, 0.5, 0.75]) AS q FROM x_relev)
          WHERE RS_market IS NOT NULL GROUP BY 1""")
def _(fx):
    return ST.rs_quartiles(days(fx), ST.rs_exact_at(strength(fx), "12:00"), "RS_market")


@query("rst14_selection_audit", "date:d symbol side",
       """WITH a AS (SELECT date, symbol FROM x_sel WHERE method = 'B0_R_alone' AND checkpoint = '09:00'),
          b AS (SELECT date, symbol FROM x_sel WHERE method = 'S1_sector_filter' AND checkpoint = '09:00')
          SELECT *, 'B0' AS side FROM a ANTI JOIN b USING (date, symbol) UNION ALL SELECT *, 'S1' FROM b ANTI JOIN a USING (date, symbol)""")
def _(fx):
    at = selected(fx).where("checkpoint = '09:00'")
    a = at.where("method = 'B0_R_alone'").select("date", "symbol")
    b = at.where("method = 'S1_sector_filter'").select("date", "symbol")
    return exclusive(a, b, ["date", "symbol"], ("B0", "S1"))
