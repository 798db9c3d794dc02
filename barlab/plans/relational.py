"""Queries for joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlab.functions import scalars as S
from barlab.functions import windows as W
from barlab.functions.ordering import with_row_number
from barlab.operators import aggregates as A
from barlab.operators import filters as L
from barlab.operators import joins as J
from barlab.operators import selection as T
from barlab.operators import sets as U
from barlab.operators.labels import contamination_by_position
from barlab.plans.registry import query
from barlab.sources import bars as B

C = F.col
CPS = ["06:00", "09:00", "12:00", "15:00"]
WS = "(PARTITION BY symbol ORDER BY date)"


def frame(n: int, first: int = 0) -> str:
    """SQL frame of ``n`` rows ending ``first`` rows before this one."""
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + first} PRECEDING AND {first} PRECEDING)"


def roll_sql(fn: str, x: str, n: int, mp: int) -> str:
    f = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} >= {mp} THEN {fn}({x}) OVER {f} END"


def trail_sql(fn: str, x: str, n: int, mp: int) -> str:
    f = frame(n, 1)
    return f"CASE WHEN count({x}) OVER {f} >= {mp} THEN {fn}({x}) OVER {f} END"


def z_sql(x: str, n: int, mp: int) -> str:
    return f"(({x}) - ({trail_sql('avg', x, n, mp)})) / nullif({trail_sql('stddev_samp', x, n, mp)}, 0)"


# joins


@query("jon01_attach_day_open", "symbol ts:t close:r day_open:r",
       """SELECT b.symbol, b.ts, b.close, o.day_open FROM x_hours b
          JOIN (SELECT symbol, d, arg_min(open, t) AS day_open FROM x_hours GROUP BY 1, 2) o USING (symbol, d)""")
def _(fx):
    return J.attach_first(fx.bars_intraday, ["symbol", "d"], "open", "t", "day_open")


@query("jon02_membership_join", "symbol benchmark_index membership_type ts:t close:r bench_close:r",
       """SELECT b.symbol, m.benchmark_index, m.membership_type, b.ts, b.close, x.close AS bench_close
          FROM x_hours b JOIN x_members m USING (symbol) JOIN x_bench x ON x.benchmark_index = m.benchmark_index AND x.ts = b.ts""")
def _(fx):
    from barlab.operators.strength import membership_map

    return J.through_membership(fx.bars_intraday, membership_map(fx.constituents, fx.universe, "ALL"), fx.bench_intraday, "close")


@query("jon03_left_join", "date:d close:r vix_open:r",
       "SELECT i.date, i.close, v.open AS vix_open FROM x_index i LEFT JOIN x_vix v USING (date)")
def _(fx):
    return fx.index_daily.join(fx.vix_daily.select("date", C("open").alias("vix_open")), "date", "left")


@query("jon04_full_join", "symbol date:d close:p index_close:r",
       """SELECT b.symbol, coalesce(b.date, i.date) AS date, b.close, i.close AS index_close
          FROM x_bars b FULL JOIN x_index i ON b.date = i.date""")
def _(fx):
    return fx.bars_daily.select("symbol", "date", "close").join(
        fx.index_daily.select("date", C("close").alias("index_close")), "date", "full")


@query("jon05_date_broadcast", "symbol date:d close:p index_ret:r",
       """SELECT symbol, date, b.close, index_ret FROM x_bars b LEFT JOIN (
            SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS index_ret FROM x_index) USING (date)""")
def _(fx):
    market = fx.index_daily.select("date", W.pct_change(C("close"), 1, W.one_series("date")).alias("index_ret"))
    return J.attach_by_date(fx.bars_daily.select("symbol", "date", "close"), market)


@query("jon06_semi_anti", "symbol date:d close:p",
       """SELECT symbol, date, close FROM x_bars WHERE symbol IN (SELECT symbol FROM x_hours)
          AND (symbol, date) NOT IN (SELECT (symbol, ex_date) FROM x_corp) AND date IN (SELECT date FROM x_events)""")
def _(fx):
    kept = B.scan_universe(fx.bars_daily, fx.universe)
    kept = L.apply_corporate_actions(kept, fx.corp_actions, "exclude", "date")
    return L.in_dates(kept, keep=fx.event_calendar)


@query("jon07_coverage", "symbol rows:i matched:i share:r",
       """SELECT symbol, count(*) AS rows, count(i.date) AS matched, avg(CASE WHEN i.date IS NULL THEN 0.0 ELSE 1.0 END) AS share
          FROM x_bars b LEFT JOIN (SELECT DISTINCT date FROM x_events) i USING (date) GROUP BY symbol""")
def _(fx):
    return J.coverage(fx.bars_daily, fx.event_calendar, ["date"], ["symbol"])


@query("jon08_asof_checkpoint", "event_id:i checkpoint",
       """SELECT event_id, strftime(TIMESTAMP '2000-01-01' + INTERVAL (max(c)) MINUTE, '%H:%M') AS checkpoint FROM (
            SELECT event_id, c FROM events LEFT JOIN (SELECT unnest([360, 540, 720, 900]) AS c) ON c <= hour(ts) * 60 + minute(ts))
          GROUP BY event_id""")
def _(fx):
    at = J.latest_at_or_before([S.to_minutes(c) for c in CPS], S.minutes(C("ts")))
    return fx.table("events").select("event_id", F.when(at.isNotNull(), S.hhmm(at)).alias("checkpoint"))


@query("jon09_align", "date:d vix_close:r",
       "SELECT i.date, v.close AS vix_close FROM (SELECT DISTINCT date FROM x_bars) i LEFT JOIN x_vix v USING (date)")
def _(fx):
    return J.align(fx.bars_daily, fx.vix_daily.select("date", C("close").alias("vix_close")))


_SLOTS = """SELECT symbol, d, t FROM (SELECT symbol, CAST(unnest(range(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY,
            INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT symbol, min(d) AS lo, max(d) AS hi FROM x_hours GROUP BY 1)),
          (SELECT unnest(range(0, 1440, 60)) AS t) WHERE isodow(d) < 6 AND d NOT IN (SELECT date FROM x_holidays)"""


@query("jon10_missing_slots", "symbol d:d t:i",
       f"SELECT s.* FROM ({_SLOTS}) s ANTI JOIN x_hours b ON b.symbol = s.symbol AND b.d = s.d AND b.t = s.t")
def _(fx):
    spans = fx.bars_intraday.groupBy("symbol").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    slots = J.expected_slots(spans, ["symbol"], "lo", "hi", range(0, 1440, 60), fx.holidays)
    return slots.join(fx.bars_intraday, ["symbol", "d", "t"], "left_anti")


def _top_sets(fx):
    by_volume = T.top_per_group(fx.bars_daily, ["date"], [F.desc("volume"), C("symbol")], 3)
    by_range = T.top_per_group(fx.bars_daily, ["date"], [F.desc(C("high") / C("low")), C("symbol")], 3)
    return by_volume.select("date", "symbol"), by_range.select("date", "symbol")


_TOPS = """a AS (SELECT date, symbol FROM x_bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) <= 3),
  b AS (SELECT date, symbol FROM x_bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY high / low DESC, symbol) <= 3)"""


@query("jon13_exclusive_picks", "date:d symbol side",
       f"""WITH {_TOPS} SELECT *, 'volume' AS side FROM a ANTI JOIN b USING (date, symbol) UNION ALL
           SELECT *, 'range' AS side FROM b ANTI JOIN a USING (date, symbol)""")
def _(fx):
    return J.exclusive(*_top_sets(fx), ["date", "symbol"], ("volume", "range"))


# aggregates


@query("agg01_session_edges", "symbol d:d session_open:r session_close:r",
       "SELECT symbol, d, arg_min(open, t) AS session_open, arg_max(close, t) AS session_close FROM x_hours GROUP BY 1, 2")
def _(fx):
    return A.session_edges(fx.bars_intraday)


@query("agg02_first_last_by_ts", "symbol year:i first_open:p last_close:p",
       """SELECT symbol, year(date) AS year, first(open ORDER BY date) AS first_open, last(close ORDER BY date) AS last_close
          FROM x_bars GROUP BY 1, 2""")
def _(fx):
    return fx.bars_daily.groupBy("symbol", F.year("date").alias("year")).agg(
        F.min_by("open", "date").alias("first_open"), F.max_by("close", "date").alias("last_close"))


def cp_sql(cps=CPS) -> str:
    out = []
    for cp in cps:
        m, v = S.label(cp), S.to_minutes(cp)
        out += [f"sum(volume) FILTER (WHERE t <= {v}) AS cv_{m}", f"arg_max(close, t) FILTER (WHERE t <= {v}) AS px_{m}",
                f"max(high) FILTER (WHERE t > {v}) AS hi_after_{m}", f"min(low) FILTER (WHERE t > {v}) AS lo_after_{m}"]
    return ", ".join(out)


_CP_COLUMNS = " ".join(f"cv_{m}:i px_{m}:r hi_after_{m}:r lo_after_{m}:r" for m in map(S.label, CPS))


@query("agg03_checkpoint_filter", f"symbol d:d {_CP_COLUMNS}", f"SELECT symbol, d, {cp_sql()} FROM x_hours GROUP BY 1, 2")
def _(fx):
    return fx.bars_intraday.groupBy("symbol", "d").agg(*A.checkpoint_columns(CPS))


@query("agg04_conditional_extremes", "symbol d:d " + " ".join(f"min_{S.label(c)}:r max_{S.label(c)}:r avg_{S.label(c)}:r" for c in CPS),
       "SELECT symbol, d, " + ", ".join(
           f"{f}(CASE WHEN t <= {S.to_minutes(c)} THEN close END) AS {f}_{S.label(c)}" for c in CPS for f in ("min", "max", "avg"))
       + " FROM x_hours GROUP BY 1, 2")
def _(fx):
    return A.conditional_extremes(fx.bars_intraday, ["symbol", "d"], "close", CPS)


@query("agg05_describe_by", "symbol n:i mean:r std:r min:p max:p total:r3 median:p",
       """SELECT symbol, count(close) AS n, avg(close) AS mean, stddev_samp(close) AS std, min(close) AS min, max(close) AS max,
          sum(close) AS total, quantile_cont(close, 0.5) AS median FROM x_bars GROUP BY symbol""")
def _(fx):
    return A.describe_by(fx.bars_daily, ["symbol"], "close")


@query("agg06_describe_all", "n:i mean:r std:r min:r p25:r p50:r p75:r max:r",
       """SELECT count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25,
          quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM events""")
def _(fx):
    return A.describe_all(fx.table("events"), "value")


@query("agg07_vwap", "symbol d:d vwap:r7",
       "SELECT symbol, d, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) AS vwap FROM x_hours GROUP BY 1, 2")
def _(fx):
    return A.vwap(fx.bars_intraday, ["symbol", "d"])


@query("agg08_path_stats", "symbol d:d path_length:r bar_vol:r",
       """SELECT symbol, d, sum(abs(close - p)) AS path_length, stddev_samp((close - p) / nullif(p, 0)) AS bar_vol
          FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, d ORDER BY ts) AS p FROM x_hours) GROUP BY 1, 2""")
def _(fx):
    return A.path_stats(fx.bars_intraday)


@query("agg09_percentile_set", "event_type p5:r p25:r p50:r p75:r p95:r",
       "SELECT event_type, " + ", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))
       + " FROM events GROUP BY 1")
def _(fx):
    return A.percentile_set(fx.table("events"), ["event_type"], "value", [.05, .25, .5, .75, .95])


_PCTS = (5, 10, 25, 50, 75, 90, 95, 99)


@query("agg10_percentile_table", "metric n:i mean:r std:r " + " ".join(f"p{p}:r" for p in _PCTS),
       "SELECT metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, "
       + ", ".join(f"quantile_cont(value, {p / 100}) AS p{p}" for p in _PCTS)
       + """ FROM (SELECT unnest(['quantity', 'discount', 'unit_price']) AS metric,
            unnest([l_quantity, l_discount, l_extendedprice / l_quantity]) AS value FROM lineitem) GROUP BY 1""")
def _(fx):
    li = fx.table("lineitem").select(C("l_quantity").alias("quantity"), C("l_discount").alias("discount"),
                                     (C("l_extendedprice") / C("l_quantity")).alias("unit_price"))
    return A.percentile_table(li, ["quantity", "discount", "unit_price"], [p / 100 for p in _PCTS])


@query("agg11_share_over", "symbol ge_1k:r ge_2k:r ge_10k:r",
       """SELECT symbol, avg(CASE WHEN high - low >= 1000 THEN 1.0 ELSE 0.0 END) AS ge_1k,
          avg(CASE WHEN high - low >= 2000 THEN 1.0 ELSE 0.0 END) AS ge_2k,
          avg(CASE WHEN high - low >= 10000 THEN 1.0 ELSE 0.0 END) AS ge_10k FROM x_bars GROUP BY symbol""")
def _(fx):
    return A.shares_over(fx.bars_daily.withColumn("range", C("high") - C("low")), ["symbol"], "range",
                         {"ge_1k": 1000, "ge_2k": 2000, "ge_10k": 10000})


@query("agg12_feasibility_total", "symbol days:i ge_1000_count:i ge_20000_count:i ge_1000_pct:r ge_20000_pct:r",
       """SELECT coalesce(symbol, 'ALL') AS symbol, days, a AS ge_1000_count, b AS ge_20000_count,
          round(a / days * 100, 1) AS ge_1000_pct, round(b / days * 100, 1) AS ge_20000_pct FROM (
            SELECT symbol, count(*) AS days, count(*) FILTER (WHERE high - low >= 1000) AS a,
              count(*) FILTER (WHERE high - low >= 20000) AS b FROM x_bars GROUP BY ROLLUP (symbol))""")
def _(fx):
    return A.feasibility(fx.bars_daily.withColumn("range", C("high") - C("low")), "symbol", "range", [1000, 20000])


@query("agg13_count_distinct", "symbol days:i years:i",
       "SELECT symbol, count(DISTINCT date) AS days, count(DISTINCT year(date)) AS years FROM x_bars GROUP BY symbol")
def _(fx):
    return fx.bars_daily.groupBy("symbol").agg(F.count_distinct("date").alias("days"), F.count_distinct(F.year("date")).alias("years"))


@query("agg14_value_counts", "event_type n:i", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(fx):
    return A.value_counts(fx.table("events"), ["event_type"])


@query("agg15_correlation", "symbol corr:r",
       "SELECT symbol, corr(high - low, CAST(volume AS DOUBLE)) AS corr FROM x_bars GROUP BY symbol")
def _(fx):
    return fx.bars_daily.withColumn("range", C("high") - C("low")).groupBy("symbol").agg(
        W.correlation(C("range"), C("volume").cast("double")).alias("corr"))


@query("agg16_mean_of_means", "symbol mean_of_means:r pooled_mean:r",
       """SELECT symbol, mean_of_means, pooled_mean FROM (SELECT symbol, avg(m) AS mean_of_means FROM (
            SELECT symbol, d, avg(close) AS m FROM x_hours GROUP BY 1, 2) GROUP BY 1)
          JOIN (SELECT symbol, avg(close) AS pooled_mean FROM x_hours GROUP BY 1) USING (symbol)""")
def _(fx):
    b = fx.bars_intraday
    return A.mean_of_means(b, ["symbol"], ["d"], "close").join(A.pooled_mean(b, ["symbol"], "close"), "symbol")


@query("agg17_pivot", "symbol O:r F:r P:r",
       """SELECT symbol, avg(p) FILTER (WHERE s = 'O') AS "O", avg(p) FILTER (WHERE s = 'F') AS "F", avg(p) FILTER (WHERE s = 'P') AS "P"
          FROM (SELECT o_orderpriority AS symbol, o_orderstatus AS s, o_totalprice AS p FROM orders) GROUP BY 1""")
def _(fx):
    return A.pivot_mean(fx.table("orders").withColumnRenamed("o_orderpriority", "symbol"), "symbol", "o_orderstatus", "o_totalprice", ["O", "F", "P"])


@query("agg18_cumulative_share", "symbol total:i share:r cumulative_share:r",
       """SELECT symbol, total, total / sum(total) OVER () AS share,
          sum(total) OVER (ORDER BY total DESC, symbol ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS cumulative_share
          FROM (SELECT symbol, sum(volume) AS total FROM x_bars GROUP BY symbol)""")
def _(fx):
    return A.cumulative_share(fx.bars_daily.groupBy("symbol").agg(F.sum("volume").alias("total")), "total", "symbol")


@query("agg19_period_buckets", "month:d n:i mean_range:r4",
       "SELECT date_trunc('month', date) AS month, count(*) AS n, avg(high - low) AS mean_range FROM x_bars GROUP BY 1")
def _(fx):
    return fx.bars_daily.groupBy(F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(C("high") - C("low")).alias("mean_range"))


@query("agg20_histogram", "bin:i n:i",
       """SELECT CAST(least(floor((least(value, hi) - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n
          FROM events, (SELECT min(value) AS lo, quantile_cont(value, 0.99) AS hi FROM events) GROUP BY 1""")
def _(fx):
    return A.histogram(fx.table("events"), "value", 20, 0.99)


# windows over (symbol, date)


def windowed(name: str, columns: str, sql: str):
    """A query that adds columns to the daily bars."""
    return query(name, "symbol date:d " + columns, f"SELECT symbol, date, {sql} FROM x_bars")


@windowed("win01_lag", "prev_close:p", f"lag(close) OVER {WS} AS prev_close")
def _(fx):
    return fx.bars_daily.withColumn("prev_close", F.lag("close").over(W.series()))


@windowed("win02_lead", "fwd_close:p", f"lead(close, 3) OVER {WS} AS fwd_close")
def _(fx):
    return fx.bars_daily.withColumn("fwd_close", F.lead("close", 3).over(W.series()))


@windowed("win03_pct_change", "ret_1:r ret_5:r", f"close / lag(close) OVER {WS} - 1 AS ret_1, close / lag(close, 5) OVER {WS} - 1 AS ret_5")
def _(fx):
    w = W.series()
    return fx.bars_daily.withColumns({"ret_1": W.pct_change(C("close"), 1, w), "ret_5": W.pct_change(C("close"), 5, w)})


@windowed("win04_rolling", "mean:r std:r lo:p hi:p total:i", ", ".join([
    roll_sql("avg", "close", 20, 10) + " AS mean", roll_sql("stddev_samp", "close", 20, 10) + " AS std",
    roll_sql("min", "low", 20, 10) + " AS lo", roll_sql("max", "high", 20, 10) + " AS hi", roll_sql("sum", "volume", 5, 3) + " AS total"]))
def _(fx):
    w = W.series()
    return fx.bars_daily.withColumns({
        "mean": W.roll(F.avg, C("close"), 20, 10, w), "std": W.roll(F.stddev_samp, C("close"), 20, 10, w),
        "lo": W.roll(F.min, C("low"), 20, 10, w), "hi": W.roll(F.max, C("high"), 20, 10, w),
        "total": W.roll(F.sum, C("volume"), 5, 3, w)})


@windowed("win05_trailing", "mean:r zscore:r", trail_sql("avg", "volume", 20, 10) + " AS mean, " + z_sql("volume", 20, 10) + " AS zscore")
def _(fx):
    w = W.series()
    return fx.bars_daily.withColumns({"mean": W.trail(F.avg, C("volume"), 20, 10, w), "zscore": W.trailing_zscore(C("volume"), 20, 10, w)})


_RETS = f"""(SELECT b.symbol, b.date, b.close / lag(b.close) OVER (PARTITION BY symbol ORDER BY b.date) - 1 AS r, m.m FROM x_bars b
  LEFT JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS m FROM x_index) m ON m.date = b.date)"""


def cov_sql(x: str, y: str, n: int, mp: int) -> str:
    return f"({roll_sql('avg', f'{x} * {y}', n, mp)} - ({roll_sql('avg', x, n, mp)}) * ({roll_sql('avg', y, n, mp)}))"


def _with_index(fx):
    w = W.series()
    market = fx.index_daily.select("date", W.pct_change(C("close"), 1, W.one_series("date")).alias("m"))
    rets = fx.bars_daily.select("symbol", "date", W.pct_change(C("close"), 1, w).alias("r"))
    return J.attach_by_date(rets, market), w


@query("win06_rolling_corr", "symbol date:d corr:r",
       f"""SELECT symbol, date, {cov_sql('r', 'm', 20, 10)} / nullif(({roll_sql('stddev_samp', 'r', 20, 10)})
           * ({roll_sql('stddev_samp', 'm', 20, 10)}), 0) AS corr FROM {_RETS}""")
def _(fx):
    df, w = _with_index(fx)
    return df.withColumn("corr", W.rolling_corr(C("r"), C("m"), 20, 10, w))


@query("win07_rolling_beta", "symbol date:d beta:r",
       f"SELECT symbol, date, {cov_sql('r', 'm', 60, 10)} / nullif({roll_sql('var_samp', 'm', 60, 10)}, 0) AS beta FROM {_RETS}")
def _(fx):
    df, w = _with_index(fx)
    return df.withColumn("beta", W.rolling_beta(C("r"), C("m"), 60, 10, w))


@query("win08_rolling_compound", "symbol date:d compounded:r5",
       f"SELECT symbol, date, exp({roll_sql('sum', 'ln(1 + r)', 5, 3)}) - 1 AS compounded FROM {_RETS}")
def _(fx):
    df, w = _with_index(fx)
    return df.withColumn("compounded", W.rolling_compound(C("r"), 5, 3, w))


@query("win09_expanding_rank", "symbol date:d rank_pct:r",
       """SELECT a.symbol, a.date, CASE WHEN count(h.v) >= 60 AND any_value(a.y) IS NOT NULL THEN
            (count(*) FILTER (WHERE h.v < a.y) + (count(*) FILTER (WHERE h.v = a.y) + 1) / 2.0) / count(h.v) END AS rank_pct
          FROM (SELECT symbol, date, n, lag(v) OVER w AS y FROM v WINDOW w AS (PARTITION BY symbol ORDER BY n)) a
          LEFT JOIN v h ON h.symbol = a.symbol AND h.n < a.n GROUP BY a.symbol, a.date""".replace(
           "FROM v WINDOW", "FROM (SELECT symbol, date, CAST(volume AS DOUBLE) AS v, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x_bars) v WINDOW"
       ).replace("LEFT JOIN v h", "LEFT JOIN (SELECT symbol, CAST(volume AS DOUBLE) AS v, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x_bars) h"))
def _(fx):
    from barlab.operators.panel import expanding_rank

    return expanding_rank(fx.bars_daily.withColumn("x", C("volume").cast("double")), "x", 60, "rank_pct")


@query("win10_running_range", "symbol ts:t run_high:r run_low:r run_range:r",
       """SELECT symbol, ts, max(high) OVER w AS run_high, min(low) OVER w AS run_low, max(high) OVER w - min(low) OVER w AS run_range
          FROM x_hours WINDOW w AS (PARTITION BY symbol, d ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _(fx):
    w = W.series(["symbol", "d"], "ts")
    hi, lo = W.running(F.max, C("high"), w), W.running(F.min, C("low"), w)
    return fx.bars_intraday.withColumns({"run_high": hi, "run_low": lo, "run_range": hi - lo})


@windowed("win11_forward_fill", "last_big:p",
          f"last_value(CASE WHEN close > 3000 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS last_big")
def _(fx):
    return fx.bars_daily.withColumn("last_big", W.forward_fill(F.when(C("close") > 3000, C("close")), W.series()))


@query("win12_centred_fractal", "symbol date:d pivot_high:p",
       """SELECT symbol, date, lag(ph, 3) OVER (PARTITION BY symbol ORDER BY date) AS pivot_high FROM (
            SELECT symbol, date, CASE WHEN count(high) OVER w = 7 AND high >= max(high) OVER w THEN high END AS ph FROM x_bars
            WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""")
def _(fx):
    w = W.series()
    at = F.when(C("high") >= W.centred_extreme(F.max, C("high"), 3, w), C("high"))
    return fx.bars_daily.withColumn("at", at).withColumn("pivot_high", F.lag("at", 3).over(w))


@query("win13_strict_fractal", "symbol ts:t is_peak:b",
       """SELECT symbol, ts, coalesce(count(high) OVER a = 2 AND count(high) OVER b = 2 AND high > max(high) OVER a AND high > max(high) OVER b, false)
          AS is_peak FROM x_hours WINDOW a AS (PARTITION BY symbol, d ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
          b AS (PARTITION BY symbol, d ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
def _(fx):
    return fx.bars_intraday.withColumn("is_peak", W.strict_peak(C("high"), 2, W.series(["symbol", "d"], "ts")))


@windowed("win14_rank_frozen", "r_rank:i", "row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS r_rank")
def _(fx):
    w = Window.partitionBy("date").orderBy(F.desc("volume"), "symbol")
    return fx.bars_daily.withColumn("r_rank", F.row_number().over(w))


@windowed("win15_bar_number", "bar_number:i", f"row_number() OVER {WS} - 1 AS bar_number")
def _(fx):
    return fx.bars_daily.withColumn("bar_number", W.bar_number(W.series()))


@windowed("win16_forward_event", "event_ahead:b",
          """coalesce(lead(1, 5) OVER (PARTITION BY symbol ORDER BY date) = 1, false) AND bool_or(high / low > 20) OVER
             (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS event_ahead""")
def _(fx):
    from barlab.operators.labels import event_within

    return fx.bars_daily.withColumn("event_ahead", event_within(C("high") / C("low") > 20, 5, W.series()))


@query("win17_adjacent_event", "date:d is_event:b is_pre:b is_post:b",
       """SELECT date, is_event, coalesce(lead(is_event) OVER w, false) AS is_pre, coalesce(lag(is_event) OVER w, false) AS is_post
          FROM (SELECT date, date IN (SELECT date FROM x_events) AS is_event FROM x_index) WINDOW w AS (ORDER BY date)""")
def _(fx):
    from barlab.operators.calendar import event_flags, pre_post_event

    flagged = pre_post_event(event_flags(fx.index_daily.select("date"), fx.event_calendar))
    return flagged.select("date", C("is_event_day").alias("is_event"), C("is_pre_event").alias("is_pre"), C("is_post_event").alias("is_post"))


@query("win18_subset_baseline", "symbol date:d baseline:r",
       """SELECT b.symbol, b.date, n.baseline FROM x_bars b LEFT JOIN (
            SELECT symbol, date, CASE WHEN count(volume) OVER w = 20 THEN avg(volume) OVER w END AS baseline
            FROM x_bars WHERE volume >= 100 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) n
          USING (symbol, date)""")
def _(fx):
    from barlab.operators.rvol import baseline_over

    return baseline_over(fx.bars_daily, C("volume") >= 100, {"baseline": C("volume")}, 20, "date")


@query("win19_contamination", "symbol date:d contaminated:b",
       """SELECT b.symbol, b.date, coalesce(bool_or(b.n >= p.n AND b.n <= p.n + CASE WHEN p.exact THEN 20 ELSE 19 END), false) AS contaminated
          FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x_bars) b
          LEFT JOIN (SELECT c.symbol, c.ex_date, min(k.n) AS n, min(k.date) = c.ex_date AS exact FROM x_corp c
            JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x_bars) k
              ON k.symbol = c.symbol AND k.date >= c.ex_date GROUP BY c.symbol, c.ex_date) p ON p.symbol = b.symbol
          GROUP BY b.symbol, b.date""")
def _(fx):
    return contamination_by_position(fx.bars_daily, fx.corp_actions, 20, "date")


@query("win20_drawdown", "symbol date:d equity:r peak:r drawdown:r",
       """SELECT *, peak - equity AS drawdown FROM (SELECT *, max(equity) OVER w AS peak FROM (
            SELECT symbol, date, sum(sign(close - open)) OVER w AS equity FROM x_bars
            WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
          WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))""")
def _(fx):
    return U.drawdown(fx.bars_daily.withColumn("step", F.signum(C("close") - C("open"))), ["symbol"], ["date"], "step")


@query("win21_streak", "symbol longest_streak:i",
       """SELECT symbol, max(CASE WHEN c THEN n ELSE 0 END) AS longest_streak FROM (SELECT symbol, c, g, count(*) AS n FROM (
            SELECT symbol, c, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, c ORDER BY date) AS g
            FROM (SELECT symbol, date, close < open AS c FROM x_bars)) GROUP BY 1, 2, 3) GROUP BY symbol""")
def _(fx):
    return U.longest_streak(fx.bars_daily, ["symbol"], ["date"], C("close") < C("open"))


@query("win22_rank_first_pct", "event_id:i rank_pct:r",
       "SELECT event_id, row_number() OVER (ORDER BY value, event_id) / count(*) OVER () AS rank_pct FROM events")
def _(fx):
    ranked = with_row_number(fx.table("events").select("event_id", "value"), [], C("value"), C("event_id"), "rn")
    return ranked.withColumn("rank_pct", C("rn") / fx.table("events").agg(F.count(F.lit(1))).scalar())


@query("win23_quantile_bins", "bin:i n:i lo:r hi:r",
       """SELECT CASE WHEN value <= q[1] THEN 1 WHEN value <= q[2] THEN 2 WHEN value <= q[3] THEN 3 ELSE 4 END AS bin, count(*) AS n,
          min(value) AS lo, max(value) AS hi FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events) GROUP BY 1""")
def _(fx):
    binned = A.quantile_bins(fx.table("events"), "value", 4)
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("win24_slope", "symbol date:d slope:r",
       f"SELECT symbol, date, sma / lag(sma, 5) OVER {WS} - 1 AS slope FROM (SELECT symbol, date, {roll_sql('avg', 'close', 20, 10)} AS sma FROM x_bars)")
def _(fx):
    w = W.series()
    return fx.bars_daily.withColumn("sma", W.roll(F.avg, C("close"), 20, 10, w)).withColumn("slope", W.pct_change(C("sma"), 5, w))


# top-k and samples


@query("top01_order_by", "symbol date:d close:p", "SELECT symbol, date, close FROM x_bars ORDER BY date, symbol")
def _(fx):
    return fx.bars_daily.orderBy("date", "symbol")


@query("top02_top_n_per_group", "date:d symbol rank:i",
       "SELECT date, symbol, rank FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS rank FROM x_bars) WHERE rank <= 3")
def _(fx):
    return T.top_per_group(fx.bars_daily, ["date"], [F.desc("volume"), C("symbol")], 3)


@query("top03_extremes", "side symbol date:d ratio:r",
       """(SELECT 'largest' AS side, symbol, date, high / low AS ratio FROM x_bars ORDER BY ratio DESC, symbol, date LIMIT 10) UNION ALL
          (SELECT 'smallest', symbol, date, high / low AS ratio FROM x_bars ORDER BY ratio, symbol, date LIMIT 10)""")
def _(fx):
    b = fx.bars_daily.withColumn("ratio", C("high") / C("low"))
    return U.labelled_union({"largest": T.extremes(b, [F.desc("ratio"), C("symbol"), C("date")], 10),
                             "smallest": T.extremes(b, [C("ratio"), C("symbol"), C("date")], 10)}, "side")


@query("top04_first_per_day", "date:d symbol t:i",
       "SELECT d AS date, symbol, t FROM x_hours QUALIFY row_number() OVER (PARTITION BY d ORDER BY t, symbol) = 1")
def _(fx):
    return T.first_per_day(fx.bars_intraday.withColumnRenamed("d", "date"), [C("t"), C("symbol")])


@query("top05_last_dates", "symbol ts:t close:r",
       "SELECT symbol, ts, close FROM x_hours WHERE d IN (SELECT DISTINCT d FROM x_hours ORDER BY d DESC LIMIT 10)")
def _(fx):
    return fx.bars_intraday.join(T.last_dates(fx.bars_intraday, "d", 10), "d", "left_semi")


@query("top06_stratified_sample", "date:d n:i",
       "SELECT date, least(count(*), 3) AS n FROM x_bars GROUP BY date")
def _(fx):
    picked = T.stratified_sample(fx.bars_daily, "date", 3, ["symbol", "date"], 42)
    return picked.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("top07_best_by", "date:d symbol volume:i",
       "SELECT date, symbol, volume FROM x_bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) = 1")
def _(fx):
    return T.best_by(fx.bars_daily, "volume", "symbol", ["date"])


@query("top08_nulls_last", "position:i c_custkey:i segment",
       """SELECT row_number() OVER (ORDER BY lower(segment) NULLS LAST, c_custkey) AS position, * FROM (
            SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS segment FROM customer)""")
def _(fx):
    c = fx.table("customer").select("c_custkey", F.when(C("c_custkey") % 4 != 0, C("c_mktsegment")).alias("segment"))
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.lower("segment").asc_nulls_last(), "c_custkey")
    return T.nulls_last(c, "segment").withColumn("position", F.row_number().over(ordered))


# set operations


@query("set01_labelled_union", "series n:i mean_close:r",
       """SELECT 'index' AS series, count(*) AS n, avg(close) AS mean_close FROM x_index UNION ALL SELECT 'vix', count(*), avg(close) FROM x_vix""")
def _(fx):
    both = U.labelled_union({"index": fx.index_daily.select("date", "close"), "vix": fx.vix_daily.select("date", "close")}, "series")
    return both.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))


@query("set02_checkpoint_blocks", "symbol d:d checkpoint cv:i",
       " UNION ALL ".join(f"SELECT symbol, d, '{c}' AS checkpoint, sum(volume) FILTER (WHERE t <= {S.to_minutes(c)}) AS cv FROM x_hours GROUP BY 1, 2" for c in CPS))
def _(fx):
    wide = fx.bars_intraday.groupBy("symbol", "d").agg(*A.checkpoint_columns(CPS))
    rows = F.array(*[F.struct(F.lit(c).alias("checkpoint"), C(f"cv_{S.label(c)}").alias("cv")) for c in CPS])
    return wide.select("symbol", "d", F.inline(rows))


@query("set03_intersect_subtract", "symbol side",
       """SELECT symbol, CASE WHEN symbol IN (SELECT symbol FROM x_hours) THEN 'both' ELSE 'daily only' END AS side FROM (SELECT DISTINCT symbol FROM x_bars)""")
def _(fx):
    daily, hourly = fx.bars_daily.select("symbol"), fx.bars_intraday.select("symbol")
    return U.labelled_union({"both": daily.intersect(hourly), "daily only": daily.subtract(hourly)}, "side")


@query("set04_distinct_keep_last", "user_id:i event_type event_id:i",
       "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def _(fx):
    return B.keep_latest(fx.table("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query("set05_overlap_next", "date:d step:i persistence:r",
       """SELECT a.date, a.step, avg(CASE WHEN b.symbol IS NULL THEN 0.0 ELSE 1.0 END) AS persistence FROM s a LEFT JOIN s b
          ON b.date = a.date AND b.symbol = a.symbol AND b.step = a.step + 1 GROUP BY 1, 2""".replace(
           "FROM s a LEFT JOIN s b", "FROM (SELECT d AS date, t // 60 AS step, symbol FROM x_hours WHERE close > open) a LEFT JOIN (SELECT d AS date, t // 60 AS step, symbol FROM x_hours WHERE close > open) b"))
def _(fx):
    picks = fx.bars_intraday.where("close > open").select(C("d").alias("date"), (C("t") / 60).cast("int").alias("step"), "symbol")
    return U.overlap_with_next(picks, ["date"], "symbol", "step")


@query("set06_long_and_wide", "symbol metric value:r4 high_mean:r4",
       """SELECT symbol, metric, value, h AS high_mean FROM (SELECT symbol, avg(high) AS h, unnest(['high', 'low', 'volume']) AS metric,
            unnest([avg(high), avg(low), avg(volume)]) AS value FROM x_bars GROUP BY symbol)""")
def _(fx):
    means = fx.bars_daily.groupBy("symbol").agg(*[F.avg(c).alias(c) for c in ("high", "low", "volume")])
    long = U.to_long(means, ["symbol"], ["high", "low", "volume"])
    wide = U.to_wide(long, ["symbol"], "metric", "value", ["high", "low", "volume"])
    return long.join(wide.select("symbol", C("high").alias("high_mean")), "symbol")


@query("set07_explode_membership", "symbol benchmark_index membership_type", "SELECT * FROM x_members")
def _(fx):
    from barlab.operators.strength import membership_map

    return membership_map(fx.constituents, fx.universe, "ALL")
