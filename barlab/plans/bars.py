"""Queries over bars: sources, sinks, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions import scalars as S
from barlab.functions.windows import pct_change, series
from barlab.operators import filters as L
from barlab.plans.registry import query
from barlab.plans.sql_base import table
from barlab.session import new_path
from barlab.sources import bars as B
from barlab.sources.fixtures import Fixtures

_STORES: dict[tuple[str, str], str] = {}
OHLCV = "open:p high:p low:p close:p volume:i"


def daily_ts(fx: Fixtures) -> DataFrame:
    return fx.bars_daily.withColumn("ts", F.col("date").cast("timestamp_ntz"))


def bar_store(fx: Fixtures) -> str:
    """The fixture bars written once per session as a partitioned bar table."""
    key = (fx.spark.sparkContext.applicationId, fx.folder)
    if key not in _STORES:
        root = new_path(fx.spark, "bars")
        # more years first: a replace must leave none of them
        later = daily_ts(fx).withColumn("ts", F.col("ts") + F.expr("interval 30 years"))
        B.write_bars(later, root, "stock", "daily")
        B.write_bars(daily_ts(fx), root, "stock", "daily")
        B.write_bars(fx.bars_intraday, root, "stock", "60min")
        index = fx.index_daily.select(F.lit("INDEX").alias("symbol"), F.col("date").cast("timestamp_ntz").alias("ts"),
                                      "open", "high", "low", "close", "volume")
        B.write_bars(index, root, "index", "daily")
        _STORES[key] = root
    return _STORES[key]


def stored(fx: Fixtures) -> DataFrame:
    return B.read_store(fx.spark, bar_store(fx))


table("x_store", """
  SELECT symbol, CAST(date AS TIMESTAMP) AS ts, open, high, low, close, volume, 'stock' AS asset_type,
    'daily' AS timeframe FROM x_bars
  UNION ALL SELECT symbol, ts, open, high, low, close, volume, 'stock', '60min' FROM x_hours
  UNION ALL SELECT 'INDEX', CAST(date AS TIMESTAMP), open, high, low, close, volume, 'index', 'daily' FROM x_index""")


# sources


@query("src01_load_bars", f"symbol ts:t {OHLCV}",
       "SELECT * FROM x_store WHERE asset_type = 'stock' AND timeframe = 'daily'")
def _(fx):
    return B.load_bars(fx.spark, bar_store(fx), asset_type="stock", timeframe="daily")


@query("src01_load_bars_symbol_range", f"symbol ts:t {OHLCV}",
       """SELECT * FROM x_store WHERE asset_type = 'stock' AND timeframe = 'daily' AND symbol = 'S1'
          AND ts >= TIMESTAMP '1996-02-01' AND ts < TIMESTAMP '1999-08-01'""")
def _(fx):
    return B.load_bars(fx.spark, bar_store(fx), "S1", "stock", "daily", "1996-02-01", "1999-07-31")


@query("src03_scan_universe", f"symbol ts:t {OHLCV}",
       "SELECT * FROM x_store WHERE timeframe = 'daily' AND asset_type = 'stock' AND symbol IN (SELECT symbol FROM x_hours)")
def _(fx):
    root = new_path(fx.spark, "files")
    daily_ts(fx).select("symbol", "ts", "open", "high", "low", "close", "volume", F.col("symbol").alias("folder")) \
        .repartition("folder").write.partitionBy("folder").parquet(root)
    symbols = [f"S{i}" for i in range(8)] + ["GONE"]
    found, _missing = B.existing_paths(fx.spark, root, [f"folder={s}" for s in symbols], "")
    return B.scan_universe(B.scan_files(fx.spark, found, r"folder=([^/]+)/"), fx.universe)


@query("src04_scan_minutes", f"symbol ts:t {OHLCV}",
       "SELECT * FROM x_hours WHERE ts >= TIMESTAMP '2024-01-08' AND t BETWEEN 540 AND 930")
def _(fx):
    return B.scan_minutes(fx.bars_intraday, "2024-01-08", "09:00", "15:30")


@query("src06_read_events_csv", "date:d event_type description impact_level",
       "SELECT date, coalesce(event_type, '') AS event_type, description, impact_level FROM x_events")
def _(fx):
    path = new_path(fx.spark, "events")
    B.write_csv(fx.event_calendar, path)
    return B.read_events_csv(fx.spark, path)


@query("src06_holiday_index_days", "date:d holiday_name",
       "SELECT h.date, h.holiday_name FROM x_holidays h WHERE h.date IN (SELECT date FROM x_index)")
def _(fx):
    path = new_path(fx.spark, "holidays")
    B.write_csv(fx.holidays, path)
    return B.read_holidays_csv(fx.spark, path).join(fx.index_daily.select("date"), "date", "left_semi")


@query("src07_corp_actions_on_bars", "symbol ex_date:d action_type ratio:r bars:i",
       """SELECT c.symbol, ex_date, action_type, ratio, count(b.date) AS bars FROM x_corp c
          LEFT JOIN x_bars b ON b.symbol = c.symbol AND b.date = c.ex_date GROUP BY ALL""")
def _(fx):
    path = new_path(fx.spark, "actions")
    extra = [F.lit(None).cast("string").alias(c) for c in ("description", "verified", "source")]
    B.write_csv(fx.corp_actions.select(F.lower("symbol").alias("symbol"), "ex_date", "action_type", "ratio", *extra), path)
    actions = B.read_corp_actions(fx.spark, path)
    bars = fx.bars_daily.select("symbol", F.col("date").alias("ex_date"), F.lit(1).alias("one"))
    return actions.join(bars, ["symbol", "ex_date"], "left").groupBy("symbol", "ex_date", "action_type", "ratio").agg(
        F.count("one").alias("bars"))


@query("src08_manifest_bars", "symbol rows:i",
       "SELECT symbol, count(*) AS rows FROM x_bars WHERE symbol IN (SELECT symbol FROM x_hours) GROUP BY symbol")
def _(fx):
    path = new_path(fx.spark, "manifest")
    fx.universe.agg(F.sort_array(F.collect_set("symbol")).alias("symbols"),
                    F.array(F.lit("INDEX")).alias("excluded_indices")).write.json(path)
    manifest = B.read_manifest(fx.spark, path)
    return B.scan_universe(fx.bars_daily, manifest).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("src09_list_available", "asset_type symbol timeframes",
       """SELECT asset_type, symbol, string_agg(timeframe, ',' ORDER BY timeframe) AS timeframes
          FROM (SELECT DISTINCT asset_type, symbol, timeframe FROM x_store) GROUP BY 1, 2""")
def _(fx):
    return B.list_available(stored(fx)).withColumn("timeframes", F.array_join("timeframes", ","))


@query("src10_bars_inventory", "asset_type timeframe symbol rows:i first_ts:t last_ts:t span_days:i",
       """SELECT asset_type, timeframe, symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
          date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS span_days FROM x_store GROUP BY 1, 2, 3""")
def _(fx):
    return B.bars_inventory(stored(fx), ["asset_type", "timeframe", "symbol"])


@query("src11_latest_bar_date", "symbol last_date:d next_date:d",
       """SELECT symbol, max(d) AS last_date, max(d) + INTERVAL 1 DAY AS next_date FROM x_hours GROUP BY symbol""")
def _(fx):
    return B.latest_bar_date(fx.bars_intraday)


@query("src12_describe_groups", "symbol n:i",
       "SELECT symbol, count(*) AS n FROM x_bars GROUP BY symbol ORDER BY n DESC, symbol LIMIT 5")
def _(fx):
    return B.describe_groups(fx.bars_daily, "symbol", 5)


@query("src12_describe_columns", "column_name non_null:i",
       """SELECT unnest(['event_id','ts','user_id','event_type','value','props']) AS column_name,
          unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS non_null
          FROM events""")
def _(fx):
    return B.describe_columns(fx.table("events"))


# sinks


@query("snk01_write_bars", "timeframe year:i rows:i total_volume:i",
       """SELECT timeframe, year(ts) AS year, count(*) AS rows, sum(volume) AS total_volume FROM x_store
          WHERE asset_type = 'stock' GROUP BY 1, 2""")
def _(fx):
    return stored(fx).where("asset_type = 'stock'").groupBy("timeframe", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("total_volume"))


@query("snk03_write_csv", "symbol n:i mean_close:r",
       "SELECT symbol, count(*) AS n, avg(close) AS mean_close FROM x_bars GROUP BY symbol")
def _(fx):
    path = new_path(fx.spark, "csv")
    summary = fx.bars_daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"))
    B.write_csv(summary, path)
    return fx.spark.read.csv(path, header=True, schema="symbol string, n long, mean_close double")


def _upsert_inputs(fx):
    old = fx.bars_daily.where(F.col("date") < "2000-01-01")
    new = fx.bars_daily.where(F.col("date") >= "1999-06-01").withColumn("close", F.col("close") + 1)
    return old, new


_UPSERT = """SELECT * REPLACE (CASE WHEN date >= DATE '{edge}' THEN close + 1 ELSE close END AS close) FROM x_bars"""


@query("snk04_upsert_incoming_wins", f"symbol date:d {OHLCV}", _UPSERT.format(edge="1999-06-01"))
def _(fx):
    return B.upsert_bars(*_upsert_inputs(fx), ["symbol", "date"])


@query("snk04_upsert_backfill", f"symbol date:d {OHLCV}", _UPSERT.format(edge="2000-01-01"))
def _(fx):
    return B.upsert_bars(*_upsert_inputs(fx), ["symbol", "date"], incoming_wins=False)


@query("snk04_merge_unique", f"symbol date:d {OHLCV}", _UPSERT.format(edge="1999-06-01"))
def _(fx):
    return B.merge_unique(*_upsert_inputs(fx), ["symbol", "date"])


@query("snk04_upsert_table", f"symbol ts:t {OHLCV}",
       """SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '1999-06-01' THEN close + 1 ELSE close END AS close) FROM x_store
          WHERE asset_type = 'stock' AND timeframe = 'daily'""")
def _(fx):
    root = new_path(fx.spark, "bars")
    old, new = (df.withColumn("ts", F.col("date").cast("timestamp_ntz")) for df in _upsert_inputs(fx))
    B.write_bars(old, root, "stock", "daily")
    B.upsert_table(fx.spark, root, new, "stock", "daily")
    return B.load_bars(fx.spark, root, asset_type="stock", timeframe="daily")


@query("snk05_date_chunks", "symbol chunk_start:d chunk_end:d",
       """SELECT symbol, CAST(c AS DATE) AS chunk_start, least(CAST(c AS DATE) + 59, hi) AS chunk_end FROM (
            SELECT symbol, hi, unnest(range(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 60 DAY)) AS c
            FROM (SELECT symbol, min(date) AS lo, max(date) AS hi FROM x_bars GROUP BY symbol))""")
def _(fx):
    spans = fx.bars_daily.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return B.date_chunks(spans, "lo", "hi", 60)


# filters and projections


@query("prj01_session_filter", f"symbol ts:t {OHLCV}", "SELECT * FROM x_hours WHERE t BETWEEN 360 AND 1080")
def _(fx):
    return L.session_filter(fx.bars_intraday, "06:00", "18:00")


@query("prj02_positive_price_filter", f"symbol date:d {OHLCV}",
       """SELECT symbol, date, open - 500 AS open, high, low, close - 1000 AS close, volume FROM x_bars
          WHERE close - 1000 > 0 AND open - 500 > 0 AND high > 0 AND low > 0""")
def _(fx):
    shifted = fx.bars_daily.withColumn("open", F.col("open") - 500).withColumn("close", F.col("close") - 1000)
    return L.positive_prices(shifted)


@query("prj03_split_ts", "event_id:i d:d hhmm t:i market_d:d market_hhmm",
       """SELECT event_id, CAST(ts AS DATE) AS d, strftime(ts, '%H:%M') AS hhmm, hour(ts) * 60 + minute(ts) AS t,
          CAST(ts + INTERVAL 330 MINUTE AS DATE) AS market_d, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') AS market_hhmm
          FROM events""")
def _(fx):
    ev = L.split_ts(fx.table("events").select("event_id", "ts"))
    moved = L.split_ts(fx.table("events").select(F.col("event_id"), F.col("ts").alias("mts")), "mts", "UTC").select(
        "event_id", F.col("d").alias("market_d"), S.clock(F.col("mts")).alias("market_hhmm"))
    return ev.withColumn("hhmm", S.clock(F.col("ts"))).join(moved, "event_id")


@query("prj04_corp_actions_exclude", f"symbol ts:t {OHLCV}",
       "SELECT b.* FROM x_hours b ANTI JOIN x_corp c ON b.symbol = c.symbol AND b.d = c.ex_date")
def _(fx):
    return L.apply_corporate_actions(fx.bars_intraday, fx.corp_actions, "exclude")


@query("prj04_corp_actions_flag", "symbol date:d close:p is_corp_action:b",
       """SELECT b.*, (b.symbol, b.date) IN (SELECT (symbol, ex_date) FROM x_corp) AS is_corp_action FROM x_bars b""")
def _(fx):
    return L.apply_corporate_actions(fx.bars_daily, fx.corp_actions, "flag", "date")


@query("prj05_mask_corp_returns", "symbol date:d ret:r",
       """SELECT symbol, date, CASE WHEN NOT (hit OR coalesce(lag(hit) OVER w, false)) THEN ret END AS ret FROM (
            SELECT symbol, date, (symbol, date) IN (SELECT (symbol, ex_date) FROM x_corp) AS hit,
              close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM x_bars)
          WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(fx):
    flagged = L.apply_corporate_actions(fx.bars_daily, fx.corp_actions, "flag", "date")
    return L.mask_returns(flagged.withColumn("ret", pct_change(F.col("close"), 1, series())), "ret", "is_corp_action", "date")


BANDS = [("tight", 0, 11), ("functional", 11, 13), ("golden", 13, 18), ("elevated", 18, 22),
         ("spreads_only", 22, 25), ("no_trade", 25, 9999)]


def band_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{n}'" for n, lo, hi in BANDS) + " ELSE 'unknown' END"


@query("prj06_banded_label", "date:d close:r band", f"SELECT date, close, {band_sql('close')} AS band FROM x_vix")
def _(fx):
    return fx.vix_daily.withColumn("band", S.banded(F.col("close"), BANDS))


@query("prj07_digitize", "event_id:i bucket:i",
       """SELECT event_id, CASE WHEN v >= 0.75 THEN 3 WHEN v >= 0.5 THEN 2 WHEN v >= 0.25 THEN 1 ELSE 0 END AS bucket
          FROM (SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value / 100 END, 0.5) AS v FROM events)""")
def _(fx):
    x = F.when(F.col("event_id") % 7 != 0, F.col("value") / 100)
    return fx.table("events").select("event_id", S.bucket_index(x, [0.25, 0.5, 0.75]).alias("bucket"))


@query("prj08_null_inf", "symbol date:d body_to_range:r log_range:r",
       """SELECT symbol, date, abs(close - open) / nullif(high - low, 0) AS body_to_range,
          CASE WHEN high > low THEN ln(high - low) END AS log_range FROM x_bars""")
def _(fx):
    b = fx.bars_daily.withColumn("body_to_range", F.try_divide(F.abs(F.col("close") - F.col("open")),
                                                               S.finite(F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))))
    b = b.withColumn("log_range", F.when(F.col("high") == F.col("low"), float("-inf")).otherwise(F.log(F.col("high") - F.col("low"))))
    return L.null_inf(b, ["log_range"])


@query("prj09_fill_defaults", "symbol date:d ret:r open_close_ratio:r",
       """SELECT symbol, date, coalesce(close / lag(close) OVER w - 1, 0) AS ret,
          coalesce(open / lag(close) OVER w, 1) AS open_close_ratio FROM x_bars
          WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(fx):
    w = series()
    b = fx.bars_daily.select("symbol", "date", pct_change(F.col("close"), 1, w).alias("ret"),
                             (F.col("open") / F.lag("close").over(w)).alias("open_close_ratio"))
    return L.fill_defaults(b, ["ret", "open_close_ratio"], ["open_close_ratio"])


@query("prj10_case_direction", "symbol date:d direction",
       """SELECT symbol, date, CASE WHEN up AND dn THEN 'both' WHEN up THEN 'up' WHEN dn THEN 'down' ELSE 'none' END AS direction
          FROM (SELECT symbol, date, high >= open * 1.5 AS up, low <= open * 0.5 AS dn FROM x_bars)""")
def _(fx):
    return fx.bars_daily.withColumn("direction", S.direction_case(F.col("high") >= F.col("open") * 1.5,
                                                                  F.col("low") <= F.col("open") * 0.5))


@query("prj13_in_dates", "symbol date:d close:p",
       """SELECT symbol, date, close FROM x_bars WHERE date IN (SELECT date FROM x_index)
          AND date NOT IN (SELECT date FROM x_events WHERE impact_level = 'high')""")
def _(fx):
    return L.in_dates(fx.bars_daily, keep=fx.index_daily, drop=fx.event_calendar.where("impact_level = 'high'"))


@query("prj14_chart_symbol", "p_partkey:i tv_symbol url",
       """SELECT p_partkey, 'NSE:' || replace(replace(s, '&', '_'), '-', '_') AS tv_symbol,
          'https://chart.example/?symbol=NSE:' || replace(replace(s, '&', '_'), '-', '_') AS url
          FROM (SELECT p_partkey, p_type || '&' || p_brand || '-' || p_name AS s FROM part)""")
def _(fx):
    s = F.concat("p_type", F.lit("&"), "p_brand", F.lit("-"), "p_name")
    tv = S.chart_symbol(s)
    return fx.table("part").select("p_partkey", tv.alias("tv_symbol"), F.concat(F.lit("https://chart.example/?symbol="), tv).alias("url"))


@query("prj15_percent_round", "symbol date:d body_pct:r",
       "SELECT symbol, date, round(abs(close - open) / open * 100, 3) AS body_pct FROM x_bars")
def _(fx):
    return fx.bars_daily.withColumn("body_pct", S.percent(F.abs(F.col("close") - F.col("open")) / F.col("open"), 3))


@query("prj16_text_filter", "n_nationkey:i n_name n_regionkey:i",
       """SELECT * FROM nation WHERE contains(lower(concat_ws(chr(9), CAST(n_nationkey AS VARCHAR), n_name,
          CAST(n_regionkey AS VARCHAR))), 'ion_1')""")
def _(fx):
    return L.text_filter(fx.table("nation"), "ION_1")


# scalar functions


@query("scl01_string", "p_partkey:i extracted upper_type swapped starts:b prefix",
       """SELECT p_partkey, regexp_extract(p_brand, 'Brand#([0-9]+)', 1) AS extracted, upper(p_name) AS upper_type,
          replace(p_name, ' ', '_') AS swapped, starts_with(p_name, 'red') AS starts, substr(p_type, 1, 3) AS prefix FROM part""")
def _(fx):
    return fx.table("part").select(
        "p_partkey", F.regexp_extract("p_brand", "Brand#([0-9]+)", 1).alias("extracted"), F.upper("p_name").alias("upper_type"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("swapped"), F.startswith("p_name", F.lit("red")).alias("starts"),
        F.substring("p_type", 1, 3).alias("prefix"))


@query("scl02_date", "date:d day_name dow:i dom:i month:i year:i month_end:d last_thursday:d week_of_month:i gap_days:i",
       """SELECT date, dayname(date) AS day_name, isodow(date) - 1 AS dow, day(date) AS dom, month(date) AS month,
          year(date) AS year, last_day(date) AS month_end,
          last_day(date) - CAST((isodow(last_day(date)) - 1 - 3 + 7) % 7 AS INTEGER) AS last_thursday,
          (day(date) - 1) // 7 + 1 AS week_of_month, date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap_days
          FROM x_index""")
def _(fx):
    from barlab.functions.windows import one_series

    d = F.col("date")
    return fx.index_daily.select(
        "date", F.date_format(d, "EEEE").alias("day_name"), F.weekday(d).alias("dow"), F.dayofmonth(d).alias("dom"),
        F.month(d).alias("month"), F.year(d).alias("year"), F.last_day(d).alias("month_end"),
        S.last_weekday_of_month(d, 3).alias("last_thursday"),
        (F.floor((F.dayofmonth(d) - 1) / 7) + 1).alias("week_of_month"),
        F.datediff(d, F.lag(d).over(one_series("date"))).alias("gap_days"))


@query("scl03_math", "symbol date:d a:p b:r c:r d:r e:r f:r g:r h:i",
       """SELECT symbol, date, abs(close - open) AS a, sign(close - open) AS b, sqrt(high) AS c, ln(high / low) AS d,
          exp(-low / high) AS e, round(close / open, 1) AS f, greatest(least(close / open, 1.5), 0.5) AS g,
          CAST(floor(close / 7) AS BIGINT) AS h FROM x_bars""")
def _(fx):
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return fx.bars_daily.select(
        "symbol", "date", F.abs(c - o).alias("a"), F.signum(c - o).alias("b"), F.sqrt(h).alias("c"), F.log(h / low).alias("d"),
        F.exp(-low / h).alias("e"), F.round(c / o, 1).alias("f"), F.greatest(F.least(c / o, F.lit(1.5)), F.lit(0.5)).alias("g"),
        F.floor(c / 7).alias("h"))


@query("scl04_conditional", "c_custkey:i tier acct:r ratio:r missing:b",
       """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS tier,
          coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, -1) AS acct,
          c_acctbal / nullif(c_custkey % 5, 0) AS ratio, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END IS NULL AS missing
          FROM customer""")
def _(fx):
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    some = F.when(key % 3 != 0, bal)
    return fx.table("customer").select(
        "c_custkey", F.when(bal > 5000, "high").when(bal > 0, "mid").otherwise("low").alias("tier"),
        F.coalesce(some, F.lit(-1.0)).alias("acct"), (bal / F.nullif(key % 5, F.lit(0))).alias("ratio"),
        F.isnull(some).alias("missing"))


@query("scl05_array_map_json", "event_id:i k:i overlap:i named back",
       """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS overlap,
          CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' END AS named,
          '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS back FROM events""")
def _(fx):
    names = F.create_map(F.lit("click"), F.lit("C"), F.lit("view"), F.lit("V"))
    k = F.from_json("props", "k long")["k"]
    return fx.table("events").select(
        "event_id", k.alias("k"),
        F.size(F.array_intersect(F.array("event_type"), F.array(F.lit("click"), F.lit("view")))).alias("overlap"),
        F.element_at(names, F.col("event_type")).alias("named"),
        F.to_json(F.struct("event_type", k.alias("k"))).alias("back"))
