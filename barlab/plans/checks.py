"""Queries for data quality and the run registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.operators import quality as Q
from barlab.operators import registry as RG
from barlab.plans.bars import stored
from barlab.plans.registry import query
from barlab.plans.sql_base import table
from barlab.sources import bars as B

C = F.col

_WEEKDAYS = """SELECT symbol, CAST(unnest(range(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT symbol, min({d}) AS lo, max({d}) AS hi FROM {src} GROUP BY 1)"""
table("x_missing", f"""
  SELECT w.symbol, w.d AS date FROM ({_WEEKDAYS.format(d='date', src='x_bars')}) w ANTI JOIN x_bars b ON b.symbol = w.symbol AND b.date = w.d
  WHERE isodow(w.d) < 6 AND w.d NOT IN (SELECT date FROM x_holidays)""")
table("x_spikes", "SELECT * FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS change FROM x_bars) WHERE change > 5")


def flawed(fx):
    """The daily bars with planted faults, one kind per remainder of the price."""
    mark = F.floor(C("close") * 100) % 97
    return fx.bars_daily.withColumns({
        "low": F.when(mark == 3, -C("low")).otherwise(C("low")),
        "high": F.when(mark == 5, C("low") / 2).otherwise(C("high")),
        "volume": F.when(mark == 7, 0).otherwise(C("volume")),
    })


table("x_flawed", """
  SELECT * REPLACE (CASE WHEN m = 3 THEN -low ELSE low END AS low, CASE WHEN m = 5 THEN low / 2 ELSE high END AS high,
    CASE WHEN m = 7 THEN 0 ELSE volume END AS volume) FROM (SELECT *, CAST(floor(close * 100) AS BIGINT) % 97 AS m FROM x_bars)""")
_BAD = "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0"


@query("dqa01_missing_daily", "symbol date:d", "SELECT * FROM x_missing")
def _(fx):
    return Q.missing_daily(fx.bars_daily, fx.holidays)


_SLOTS = Q.session_slots("60min")


@query("dqa02_missing_intraday", "symbol d:d t:i",
       f"""SELECT w.symbol, w.d, s.t FROM ({_WEEKDAYS.format(d='d', src='x_shifted')}) w, (SELECT unnest({_SLOTS}) AS t) s
           ANTI JOIN x_shifted b ON b.symbol = w.symbol AND b.d = w.d AND b.t = s.t
           WHERE isodow(w.d) < 6 AND w.d NOT IN (SELECT date FROM x_holidays)""")
def _(fx):
    # hourly bars moved to quarter past, where the session slots lie
    moved = fx.bars_intraday.withColumn("ts", C("ts") + F.make_dt_interval(mins=F.lit(15)))
    return Q.missing_intraday(moved, fx.holidays, _SLOTS)


table("x_shifted", "SELECT symbol, d, t + 15 AS t FROM x_hours")


@query("dqa03_bad_prices", "symbol rows:i bad_prices:i", f"SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE {_BAD}) AS bad_prices FROM x_flawed GROUP BY 1")
def _(fx):
    return Q.count_checks(flawed(fx), ["symbol"])


@query("dqa04_corrupt_candles", "symbol corrupt_candles:i", "SELECT symbol, count(*) FILTER (WHERE high < low) AS corrupt_candles FROM x_flawed GROUP BY 1")
def _(fx):
    return Q.count_checks(flawed(fx), ["symbol"])


@query("dqa05_spikes", "symbol spikes:i shown",
       """SELECT symbol, max(n) AS spikes, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE k <= 10) AS shown FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x_spikes) GROUP BY 1""")
def _(fx):
    found = Q.spikes(fx.bars_daily, 5.0, ["symbol"], "date")
    return found.withColumn("shown", F.array_join(F.transform("first_spikes", lambda d: d.cast("string")), ","))


@query("dqa05_intraday_spikes", "symbol ts:t change:r",
       """SELECT symbol, ts, change FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS change FROM x_hours)
          WHERE change > 3""")
def _(fx):
    return Q.intraday_spike_rows(fx.bars_intraday, 3.0)


@query("dqa06_duplicate_ts", "symbol duplicates:i",
       """SELECT symbol, count(*) - count(DISTINCT date) AS duplicates FROM (
            SELECT symbol, date FROM x_bars UNION ALL SELECT symbol, date FROM x_bars WHERE volume > 200) GROUP BY 1""")
def _(fx):
    twice = fx.bars_daily.unionByName(fx.bars_daily.where("volume > 200"))
    return Q.duplicate_times(twice, ["symbol"], "date")


def _texts(threshold: str) -> str:
    """The issue sentences of the report over counts and the joined first times."""
    return f"""concat_ws('; ',
      CASE WHEN missing > 0 THEN CAST(missing AS VARCHAR) || ' expected bars are absent' END,
      CASE WHEN bad_prices > 0 THEN CAST(bad_prices AS VARCHAR) || ' bars hold a price of zero or less' END,
      CASE WHEN corrupt_candles > 0 THEN CAST(corrupt_candles AS VARCHAR) || ' bars have their high under their low' END,
      CASE WHEN spikes > 0 THEN CAST(spikes AS VARCHAR) || ' closes moved by more than {threshold}: ' || shown
        || CASE WHEN spikes > 10 THEN ' (first 10)' ELSE '' END END,
      CASE WHEN duplicates > 0 THEN CAST(duplicates AS VARCHAR) || ' bars repeat the time of another' END)"""


@query("dqa07_validate", "symbol rows:i first_date:d last_date:d missing:i bad_prices:i corrupt_candles:i spikes:i duplicates:i clean:b texts",
       f"""SELECT *, texts = '' AS clean FROM (SELECT *, {_texts('500%')} AS texts FROM (
            SELECT symbol, rows, first_date, last_date, bad_prices, corrupt_candles, 0 AS duplicates, coalesce(missing, 0) AS missing,
              coalesce(spikes, 0) AS spikes, shown FROM (
            SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE {_BAD}) AS bad_prices,
              count(*) FILTER (WHERE high < low) AS corrupt_candles FROM x_flawed GROUP BY 1)
            LEFT JOIN (SELECT symbol, count(*) AS missing FROM x_missing GROUP BY 1) USING (symbol)
            LEFT JOIN (SELECT symbol, max(n) AS spikes, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) FILTER (WHERE k <= 10) AS shown FROM (
              SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x_spikes) GROUP BY 1)
              USING (symbol)))""")
def _(fx):
    return Q.validate(flawed(fx), fx.holidays, 5.0).withColumn("texts", F.array_join("issues", "; "))


# every stored series with planted faults; intraday bars lie a quarter past, where the session slots are
table("x_batch", """
  SELECT symbol, asset_type, timeframe, CASE WHEN timeframe = 'daily' THEN ts ELSE ts + INTERVAL 15 MINUTE END AS ts, open,
    CASE WHEN m = 5 THEN low / 2 ELSE high END AS high, CASE WHEN m = 3 THEN -low ELSE low END AS low, close
  FROM (SELECT *, CAST(floor(close * 100) AS BIGINT) % 97 AS m FROM x_store) CROSS JOIN (VALUES (1), (2)) AS c(copy) WHERE copy = 1 OR m = 11""")
_ABSENT = [("S0", "stock", "15min"), ("GHOST", "stock", "daily"), ("S1", "stock", "7min")]
table("x_wanted", f"""
  SELECT DISTINCT symbol, asset_type, timeframe FROM x_store
  UNION ALL SELECT * FROM (VALUES {', '.join(str(row) for row in _ABSENT)}) AS a(symbol, asset_type, timeframe)""")
_SERIES = "symbol, asset_type, timeframe"
table("x_batch_due", f"""
  SELECT {_SERIES}, d, CASE WHEN timeframe = 'daily' THEN CAST(d AS TIMESTAMP) ELSE CAST(d AS TIMESTAMP) + to_minutes(CAST(t AS BIGINT)) END AS ts FROM (
    SELECT {_SERIES}, CAST(unnest(range(date_trunc('day', lo), date_trunc('day', hi) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d
    FROM (SELECT {_SERIES}, min(ts) AS lo, max(ts) AS hi FROM x_batch GROUP BY ALL HAVING count(*) > 1))
  JOIN (SELECT 'daily' AS timeframe, 0 AS t UNION ALL SELECT '60min', unnest({_SLOTS})) USING (timeframe)
  WHERE isodow(d) < 6 AND d NOT IN (SELECT date FROM x_holidays)""")
table("x_batch_jumps", f"""
  SELECT *, row_number() OVER (PARTITION BY {_SERIES} ORDER BY ts) AS k, count(*) OVER (PARTITION BY {_SERIES}) AS n FROM (
    SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY {_SERIES} ORDER BY ts, close), 0) - 1) AS change FROM x_batch) WHERE change > 3""")


@query("dqa07_batch_report",
       "symbol asset_type timeframe rows:i first_ts:t last_ts:t missing:i bad_prices:i corrupt_candles:i spikes:i duplicates:i clean:b texts",
       f"""SELECT *, texts = '' AS clean FROM (SELECT * REPLACE (CASE WHEN rows > 0 THEN texts WHEN timeframe = '7min'
            THEN 'no bars are stored and the timeframe is unknown' ELSE 'no bars are stored' END AS texts) FROM (SELECT *, {_texts('300%')} AS texts FROM (
            SELECT {_SERIES}, first_ts, last_ts, shown, coalesce(rows, 0) AS rows, coalesce(bad_prices, 0) AS bad_prices, coalesce(spikes, 0) AS spikes,
              coalesce(corrupt_candles, 0) AS corrupt_candles, coalesce(duplicates, 0) AS duplicates, coalesce(missing, 0) AS missing
            FROM x_wanted LEFT JOIN (
              SELECT {_SERIES}, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE {_BAD}) AS bad_prices,
                count(*) FILTER (WHERE high < low) AS corrupt_candles, count(*) - count(DISTINCT ts) AS duplicates FROM x_batch GROUP BY ALL) USING ({_SERIES})
            LEFT JOIN (SELECT {_SERIES}, max(n) AS spikes, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ', ' ORDER BY ts) FILTER (WHERE k <= 10) AS shown
              FROM x_batch_jumps GROUP BY ALL) USING ({_SERIES})
            LEFT JOIN (SELECT {_SERIES}, count(*) AS missing FROM x_batch_due ANTI JOIN x_batch USING ({_SERIES}, ts) GROUP BY ALL) USING ({_SERIES}))))""")
def _(fx):
    mark = F.floor(C("close") * 100) % 97
    late = F.when(C("timeframe") == "daily", C("ts")).otherwise(C("ts") + F.make_dt_interval(mins=F.lit(15)))
    bars = stored(fx).withColumns({
        "low": F.when(mark == 3, -C("low")).otherwise(C("low")), "high": F.when(mark == 5, C("low") / 2).otherwise(C("high")), "ts": late,
    }).withColumn("_copy", F.explode(F.when(mark == 11, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    wanted = stored(fx).select(*Q.INSTRUMENT).distinct().unionByName(fx.spark.createDataFrame(_ABSENT, ["symbol", "asset_type", "timeframe"]))
    report = Q.batch_report(bars, wanted, fx.holidays, 3.0)
    return report.withColumn("texts", F.array_join("issues", "; "))


@query("dqa08_ohlc_consistency", "symbol rows:i high_lt_low:i high_lt_open:i high_lt_close:i low_gt_open:i low_gt_close:i price_le_0:i zero_volume:i",
       f"""SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE high < low) AS high_lt_low, count(*) FILTER (WHERE high < open) AS high_lt_open,
          count(*) FILTER (WHERE high < close) AS high_lt_close, count(*) FILTER (WHERE low > open) AS low_gt_open,
          count(*) FILTER (WHERE low > close) AS low_gt_close, count(*) FILTER (WHERE {_BAD}) AS price_le_0,
          count(*) FILTER (WHERE volume = 0) AS zero_volume FROM x_flawed GROUP BY 1""")
def _(fx):
    return Q.ohlc_consistency(flawed(fx))


_MIN = {"daily": 2370, "60min": 670, "1min": 1}


@query("dqa09_completeness", "symbol timeframe rows:i missing:b low_rows:b late_start:b",
       f"""SELECT e.symbol, e.timeframe, i.rows, i.rows IS NULL AS missing, coalesce(i.rows < e.min_rows, false) AS low_rows,
          coalesce(e.timeframe = 'daily' AND CAST(i.lo AS DATE) > DATE '1995-01-02', false) AS late_start
          FROM (SELECT s.symbol, t.* FROM (SELECT DISTINCT symbol FROM x_store WHERE asset_type = 'stock') s,
            (VALUES {', '.join(f"('{t}', {n})" for t, n in _MIN.items())}) AS t(timeframe, min_rows)) e
          LEFT JOIN (SELECT symbol, timeframe, count(*) AS rows, min(ts) AS lo FROM x_store WHERE asset_type = 'stock' GROUP BY 1, 2) i USING (symbol, timeframe)""")
def _(fx):
    stocks = stored(fx).where("asset_type = 'stock'")
    return Q.completeness(B.bars_inventory(stocks, ["symbol", "timeframe"]), stocks, _MIN, "1995-01-02")


@query("dqa10_cross_timeframe", "symbol daily_days:i intraday_days:i day_gap:i daily_close:r intraday_close:r close_diff:r days_differ:b close_differs:b",
       """SELECT symbol, daily_days, intraday_days, abs(daily_days - intraday_days) AS day_gap, daily_close, intraday_close,
          abs(daily_close - intraday_close) / daily_close AS close_diff, abs(daily_days - intraday_days) > 20 AS days_differ,
          abs(daily_close - intraday_close) / daily_close > 0.01 AS close_differs FROM (
          SELECT symbol, count(DISTINCT d) AS daily_days, max(d) AS last_d, arg_max(c, d) AS daily_close FROM (
            SELECT symbol, d, max(close) AS c FROM x_hours GROUP BY 1, 2) GROUP BY 1)
          JOIN (SELECT symbol, count(DISTINCT d) AS intraday_days FROM x_hours GROUP BY 1) USING (symbol)
          JOIN (SELECT symbol, d AS last_d, arg_max(close, ts) AS intraday_close FROM x_hours GROUP BY 1, 2) USING (symbol, last_d)""")
def _(fx):
    daily = fx.bars_intraday.groupBy("symbol", "d").agg(F.max("close").alias("close"))
    return Q.cross_timeframe(daily, fx.bars_intraday)


@query("dqa11_file_integrity", "asset_type timeframe rows:i null_prices:i min_price:p crossed:i days:i outside_hours:i",
       """SELECT asset_type, timeframe, count(*) AS rows, 0 AS null_prices, min(least(open, high, low, close)) AS min_price, 0 AS crossed,
          count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (WHERE hour(ts) < 9 OR hour(ts) >= 16) AS outside_hours
          FROM x_store GROUP BY 1, 2""")
def _(fx):
    return Q.file_integrity(stored(fx), ["asset_type", "timeframe"])


@query("dqa11_rows_per_year", "asset_type timeframe year:i rows:i days:i",
       "SELECT asset_type, timeframe, year(ts) AS year, count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS days FROM x_store GROUP BY 1, 2, 3")
def _(fx):
    return Q.rows_per_year(stored(fx), ["asset_type", "timeframe"])


@query("dqa11_unsorted_rows", "user_id:i out_of_order:i",
       """SELECT user_id, count(*) FILTER (WHERE b) AS out_of_order FROM (
            SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) > ts AS b FROM events) GROUP BY 1""")
def _(fx):
    return Q.unsorted_rows(fx.table("events"), ["user_id"], ["value", "event_id"])


@query("dqa12_detect_corp_actions", "symbol date:d ratio:r4",
       """SELECT symbol, date, ratio FROM (SELECT *, open / prev_close AS ratio FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM x_bars))
          WHERE ratio < 0.75 OR ratio > 1.25""")
def _(fx):
    return Q.detect_corporate_actions(fx.bars_daily)


@query("dqa13_spot_check", "symbol date:d close:p ok:b",
       """SELECT symbol, date, close, close BETWEEN lb AND hb AS ok FROM x_bars JOIN (
            SELECT date, quantile_cont(close, 0.25) AS lb, quantile_cont(close, 0.75) AS hb FROM x_bars GROUP BY 1) USING (date)""")
def _(fx):
    bands = fx.bars_daily.groupBy("date").agg(F.percentile("close", 0.25).alias("low_bound"), F.percentile("close", 0.75).alias("high_bound"))
    expected = fx.bars_daily.select("symbol", "date").join(bands, "date")
    return Q.spot_check(fx.bars_daily, expected)


@query("dqa13_bars_per_day", "symbol mean_bars:r min_bars:i max_bars:i",
       "SELECT symbol, avg(n) AS mean_bars, min(n) AS min_bars, max(n) AS max_bars FROM (SELECT symbol, d, count(*) AS n FROM x_hours GROUP BY 1, 2) GROUP BY 1")
def _(fx):
    return Q.bars_per_day(fx.bars_intraday)


@query("dqa14_freshness", "asset_type timeframe symbol last_date:d age_days:i stale:b",
       """SELECT asset_type, timeframe, symbol, CAST(max(ts) AS DATE) AS last_date, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-03') AS age_days,
          date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-03') > 7 AS stale FROM x_store GROUP BY 1, 2, 3""")
def _(fx):
    return Q.freshness(stored(fx), ["asset_type", "timeframe", "symbol"], F.lit("2024-02-03").cast("date"))


# run registry: region are strategies, nation categories, customer tests, orders runs, lineitem insights


def strategies(fx):
    return fx.table("region").select(C("r_regionkey").alias("strategy_id"), C("r_name").alias("strategy_name"))


def cats(fx):
    return fx.table("nation").select(C("n_nationkey").alias("category_id"), C("n_name").alias("category_name"),
                                     C("n_regionkey").alias("strategy_id"), C("n_nationkey").alias("display_order"))


def tests(fx):
    return fx.table("customer").select(C("c_custkey").alias("test_id"), C("c_name").alias("test_name"), C("c_nationkey").alias("category_id"))


def runs(fx):
    return fx.table("orders").select(
        C("o_orderkey").alias("run_id"), C("o_custkey").alias("test_id"), C("o_orderpriority").alias("instrument"),
        F.when(C("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), C("o_orderdate").alias("run_at"))


def insights(fx):
    flag = C("l_returnflag")
    return fx.table("lineitem").select(
        C("l_orderkey").alias("run_id"), C("l_linenumber").alias("insight_id"), C("l_partkey").alias("insight_key"),
        F.when(flag == "A", "critical").when(flag == "N", "important").otherwise("info").alias("severity"), C("l_extendedprice").alias("value"))


table("x_runs", """SELECT o_orderkey AS run_id, o_custkey AS test_id, o_orderpriority AS instrument,
  CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failed' END AS status, o_orderdate AS run_at FROM orders""")
table("x_insights", """SELECT l_orderkey AS run_id, l_linenumber AS insight_id, l_partkey AS insight_key,
  CASE l_returnflag WHEN 'A' THEN 'critical' WHEN 'N' THEN 'important' ELSE 'info' END AS severity, l_extendedprice AS value FROM lineitem""")


@query("reg01_tests_with_category", "test_id:i test_name category_id:i category_name strategy_id:i",
       """SELECT c_custkey AS test_id, c_name AS test_name, n_nationkey AS category_id, n_name AS category_name, n_regionkey AS strategy_id
          FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(fx):
    return RG.tests_with_category(tests(fx), cats(fx))


@query("reg01_categories", "strategy_id:i strategy_name category_id:i category_name display_order:i",
       """SELECT r_regionkey AS strategy_id, r_name AS strategy_name, n_nationkey AS category_id, n_name AS category_name, n_nationkey AS display_order
          FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(fx):
    return RG.categories(cats(fx), strategies(fx))


@query("reg02_latest_run", "test_id:i instrument run_at:t run_id:i",
       """SELECT * FROM x_runs WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY test_id, instrument ORDER BY run_at DESC, run_id DESC) = 1""")
def _(fx):
    return RG.latest_run(runs(fx), ["test_id", "instrument"])


@query("reg02_run_history", "test_id:i instrument run_at:t run_id:i status nth:i",
       "SELECT *, row_number() OVER (PARTITION BY test_id, instrument ORDER BY run_at DESC, run_id DESC) AS nth FROM x_runs")
def _(fx):
    return RG.run_history(runs(fx), ["test_id", "instrument"])


@query("reg03_all_insights", "strategy_name test_name run_id:i insight_id:i severity severity_rank:i value:r",
       """SELECT r_name AS strategy_name, c_name AS test_name, i.run_id, insight_id, severity,
          CASE severity WHEN 'critical' THEN 1 WHEN 'important' THEN 2 ELSE 3 END AS severity_rank, value
          FROM x_insights i JOIN x_runs r ON r.run_id = i.run_id AND status = 'success' JOIN customer ON c_custkey = test_id
          JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(fx):
    return RG.all_insights(insights(fx), runs(fx), tests(fx), cats(fx), strategies(fx))


@query("reg04_test_completion", "strategy_id:i total:i completed:i",
       """SELECT n_regionkey AS strategy_id, count(DISTINCT c_custkey) AS total, count(DISTINCT r.test_id) AS completed FROM customer
          JOIN nation ON n_nationkey = c_nationkey LEFT JOIN x_runs r ON r.test_id = c_custkey AND status = 'success' GROUP BY 1""")
def _(fx):
    return RG.test_completion(tests(fx), cats(fx), runs(fx))


def _snapshot(fx, status):
    kept = runs(fx).where(C("status") == status).select("run_id", "test_id")
    joined = insights(fx).join(kept, "run_id")
    return joined.groupBy("test_id", "severity").agg(F.count(F.lit(1)).alias("value"))


@query("reg05_insight_diff", "test_id:i severity value_1:i value_2:i state",
       """SELECT coalesce(a.test_id, b.test_id) AS test_id, coalesce(a.severity, b.severity) AS severity, a.v AS value_1, b.v AS value_2,
          CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state
          FROM (SELECT test_id, severity, count(*) AS v FROM x_insights JOIN x_runs USING (run_id) WHERE status = 'failed' GROUP BY 1, 2) a
          FULL JOIN (SELECT test_id, severity, count(*) AS v FROM x_insights JOIN x_runs USING (run_id) WHERE status = 'success' GROUP BY 1, 2) b
          ON a.test_id = b.test_id AND a.severity = b.severity""")
def _(fx):
    return RG.insight_diff(_snapshot(fx, "failed"), _snapshot(fx, "success"), ["test_id", "severity"])


@query("reg06_insight_counts", "run_id:i n:i critical:i important:i info:i",
       """SELECT run_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'important') AS important,
          count(*) FILTER (WHERE severity = 'info') AS info FROM x_insights GROUP BY 1""")
def _(fx):
    return RG.insight_counts(insights(fx), ["run_id"])


@query("reg06_run_rollup", "test_id:i runs:i insights:i",
       """SELECT test_id, count(*) AS runs, coalesce(sum(n), 0) AS insights FROM x_runs LEFT JOIN (
            SELECT run_id, count(*) AS n FROM x_insights GROUP BY 1) USING (run_id) GROUP BY 1""")
def _(fx):
    return RG.run_rollup(runs(fx), insights(fx))
