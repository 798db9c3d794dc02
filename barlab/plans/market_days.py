"""Queries for session, volatility, swing, calendar and master-table features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlab.functions import scalars as S
from barlab.operators import calendar as CAL
from barlab.operators import days as D
from barlab.operators import swings as SW
from barlab.plans.bars import band_sql
from barlab.plans.registry import query
from barlab.plans.sql_base import table

C = F.col
THRESHOLDS = (20000, 30000, 40000)
ZONE_LOW, ZONE_HIGH = 100000, 150000

table("x_ses", """
  SELECT i.date, i.open AS session_open, i.high AS session_high, i.low AS session_low, i.close AS session_close,
    i.high - i.low AS session_range, i.p AS prev_close, i.open - i.p AS gap, (i.open - i.p) / nullif(i.p, 0) AS gap_pct,
    i.open * (v.open / 100) / 16 AS dvr, (i.high - i.low) / nullif(i.open * (v.open / 100) / 16, 0) AS dvr_ratio
  FROM (SELECT *, lag(close) OVER (ORDER BY date) AS p FROM x_index) i LEFT JOIN x_vix v USING (date)""")
table("x_used", "SELECT a.date, " + ", ".join(
    f"CASE WHEN s.dvr > 0 THEN h{i} / s.dvr END AS dvr_consumed_h{i}" for i in range(1, 7))
    + " FROM (SELECT d AS date, " + ", ".join(
    f"max(high) FILTER (WHERE t <= {S.to_minutes(c)}) - min(low) FILTER (WHERE t <= {S.to_minutes(c)}) AS h{i}"
    for i, c in enumerate(D.RANGE_CUTS, 1)) + " FROM x_session GROUP BY 1) a LEFT JOIN x_ses s USING (date)")
table("x_volf", f"""
  SELECT date, open AS vix_open, close AS vix_close, p AS vix_prev_close, close / nullif(p, 0) - 1 AS vix_change_pct,
    CASE WHEN close > p THEN 'rising' ELSE 'falling' END AS vix_direction,
    coalesce(close / nullif(p, 0) - 1 > 0.05, false) AS vix_downgrade, {band_sql('close')} AS vix_regime
  FROM (SELECT *, lag(close) OVER (ORDER BY date) AS p FROM x_vix)""")

# zig-zag as a recursion over the bar number

table("x_zbars", """
  SELECT d, ts, t, high, low, close, row_number() OVER (PARTITION BY d ORDER BY ts) AS i, count(*) OVER (PARTITION BY d) AS n,
    first(close) OVER (PARTITION BY d ORDER BY ts) AS c0 FROM x_session""")
table("x_zig", f"""
  SELECT d, thr, i, n, up, ts AS s_ts, close AS s_px, high AS hi, low AS lo, ts AS p_ts, false AS turned,
    CAST(NULL AS BOOLEAN) AS e_up, CAST(NULL AS DOUBLE) AS e_mag, CAST(NULL AS TIMESTAMP) AS e_start,
    CAST(NULL AS TIMESTAMP) AS e_peak, CAST(NULL AS DOUBLE) AS e_px
  FROM x_zbars JOIN (SELECT d, arg_min(close > c0, i) AS up FROM x_zbars WHERE close <> c0 GROUP BY d) USING (d),
    (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS thr) WHERE i = 1
  UNION ALL /* recursive */
  SELECT d, thr, i, n, CASE WHEN turn THEN NOT up ELSE up END, CASE WHEN turn THEN peak_ts ELSE s_ts END,
    CASE WHEN turn THEN peak ELSE s_px END, CASE WHEN turn THEN high ELSE nhi END, CASE WHEN turn THEN low ELSE nlo END,
    CASE WHEN turn THEN ts ELSE peak_ts END, turn, up, abs(peak - s_px), s_ts, peak_ts, peak
  FROM (SELECT *, CASE WHEN up THEN nhi ELSE nlo END AS peak, CASE WHEN up THEN nhi - low >= thr ELSE high - nlo >= thr END AS turn
        FROM (SELECT z.d, z.thr, b.i, z.n, z.up, z.s_ts, z.s_px, greatest(z.hi, b.high) AS nhi, least(z.lo, b.low) AS nlo,
                CASE WHEN (z.up AND b.high > z.hi) OR (NOT z.up AND b.low < z.lo) THEN b.ts ELSE z.p_ts END AS peak_ts,
                b.ts, b.high, b.low FROM x_zig z JOIN x_zbars b ON b.d = z.d AND b.i = z.i + 1))""")
table("x_swings", """
  SELECT d, thr, row_number() OVER (PARTITION BY d, thr ORDER BY i, k) - 1 AS swing_no,
    CASE WHEN up THEN 'up' ELSE 'down' END AS direction, magnitude, start_ts, peak_ts, peak_price FROM (
    SELECT d, thr, i, 0 AS k, e_up AS up, e_mag AS magnitude, e_start AS start_ts, e_peak AS peak_ts, e_px AS peak_price
    FROM x_zig WHERE turned
    UNION ALL SELECT d, thr, i, 1, up, abs(CASE WHEN up THEN hi ELSE lo END - s_px), s_ts, p_ts, CASE WHEN up THEN hi ELSE lo END
    FROM x_zig WHERE i = n AND n >= 2)""")
table("x_largest", f"""
  SELECT d, thr, direction, magnitude, start_ts AS start_time, peak_ts AS peak_time,
    CASE WHEN bars <= 1 THEN 0 WHEN direction = 'up' THEN peak_price - lo ELSE hi - peak_price END AS retracement, false_starts FROM (
    SELECT w.*, (SELECT count(*) FROM x_zbars b WHERE b.d = w.d AND b.ts >= w.peak_ts) AS bars,
      (SELECT min(low) FROM x_zbars b WHERE b.d = w.d AND b.ts >= w.peak_ts) AS lo,
      (SELECT max(high) FROM x_zbars b WHERE b.d = w.d AND b.ts >= w.peak_ts) AS hi,
      (SELECT count(DISTINCT s.swing_no) FROM x_swings s JOIN x_swings o ON o.d = s.d AND o.thr = s.thr AND o.swing_no > s.swing_no
         AND o.direction <> s.direction AND o.magnitude > s.magnitude
       WHERE s.d = w.d AND s.thr = w.thr AND s.swing_no < w.swing_no AND s.magnitude < {ZONE_LOW}) AS false_starts
    FROM (SELECT * FROM x_swings QUALIFY row_number() OVER (PARTITION BY d, thr ORDER BY magnitude DESC, swing_no) = 1) w)""")
_wide = []
for _t in THRESHOLDS:
    for _f in SW.SWING_FIELDS:
        _wide.append(f"max({_f}) FILTER (WHERE thr = {_t}) AS swing_{_t}_{_f}" if _f != "false_starts"
                     else f"coalesce(max({_f}) FILTER (WHERE thr = {_t}), 0) AS swing_{_t}_{_f}")
table("x_swingday", f"""
  SELECT *, coalesce(swing_30000_magnitude >= {ZONE_LOW}, false) AS capture_zone_100,
    coalesce(swing_30000_magnitude >= {ZONE_HIGH}, false) AS capture_zone_150 FROM (
    SELECT b.d AS date, {', '.join(_wide)} FROM (SELECT DISTINCT d FROM x_session) b LEFT JOIN x_largest l USING (d) GROUP BY b.d)""")

EXPIRY_CHANGE = "1999-09-01"
table("x_days", f"""
  SELECT date, dayname(date) AS day_of_week, (day(date) - 1) // 7 + 1 AS week_of_month, month(date) AS month,
    isodow(date) = CASE WHEN date < DATE '{EXPIRY_CHANGE}' THEN 4 ELSE 2 END AS is_expiry_day,
    isodow(date) = CASE WHEN date < DATE '{EXPIRY_CHANGE}' THEN 4 ELSE 2 END AS is_no_trade_day FROM x_index""")
table("x_one_event", """
  SELECT date, event_type, impact_level AS event_impact FROM x_events QUALIFY row_number() OVER (PARTITION BY date
    ORDER BY CASE impact_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, event_type) = 1""")
table("x_cal", """
  SELECT *, coalesce(lead(is_event_day) OVER (ORDER BY date), false) AS is_pre_event,
    coalesce(lag(is_event_day) OVER (ORDER BY date), false) AS is_post_event FROM (
    SELECT d.*, e.date IS NOT NULL AS is_event_day, coalesce(e.event_type, '') AS event_type,
      coalesce(e.event_impact, '') AS event_impact FROM x_days d LEFT JOIN x_one_event e USING (date))""")
table("x_master", """
  SELECT * EXCLUDE (rn) FROM (SELECT s.*, u.* EXCLUDE (date), v.* EXCLUDE (date), w.* EXCLUDE (date), c.* EXCLUDE (date),
    v.vix_regime IS NULL AS vix_data_missing, row_number() OVER (ORDER BY s.date) AS rn
    FROM x_ses s LEFT JOIN x_used u USING (date) LEFT JOIN x_volf v USING (date) LEFT JOIN x_swingday w USING (date)
    LEFT JOIN x_cal c USING (date)) WHERE rn > 1""")


def session(fx):
    return D.session_features(fx.index_daily, fx.vix_daily)


def swing_days(fx):
    out = SW.swing_day_features(fx.index_session, ["d"], THRESHOLDS, 30000, ZONE_LOW, ZONE_HIGH)
    return out.withColumnRenamed("d", "date")


def master(fx):
    ses = session(fx)
    return D.master_day_table(
        ses, D.dvr_consumed(fx.index_session, ses), D.vix_features(fx.vix_daily), swing_days(fx),
        CAL.day_calendar(fx.index_daily, fx.event_calendar, EXPIRY_CHANGE))


SES = ("date:d session_open:r session_high:r session_low:r session_close:r session_range:r prev_close:r gap:r gap_pct:r "
       "dvr:r dvr_ratio:r")
VOL = "vix_open:r vix_close:r vix_prev_close:r vix_direction vix_change_pct:r vix_downgrade:b vix_regime"
CALC = ("day_of_week week_of_month:i month:i is_expiry_day:b is_no_trade_day:b is_event_day:b event_type event_impact "
        "is_pre_event:b is_post_event:b")
USED = " ".join(f"dvr_consumed_h{i}:r" for i in range(1, 7))
_KIND = {"direction": "s", "magnitude": "r", "start_time": "t", "peak_time": "t", "retracement": "r", "false_starts": "i"}
SWD = " ".join(f"swing_{t}_{f}:{_KIND[f]}" for t in THRESHOLDS for f in SW.SWING_FIELDS) + " capture_zone_100:b capture_zone_150:b"


@query("ses01_session_features", SES, "SELECT * FROM x_ses")
def _(fx):
    return session(fx)


@query("ses02_dvr_consumed", f"date:d {USED}", "SELECT * FROM x_used")
def _(fx):
    return D.dvr_consumed(fx.index_session, session(fx))


@query("vol01_vix_features", f"date:d {VOL}", "SELECT * FROM x_volf")
def _(fx):
    return D.vix_features(fx.vix_daily)


@query("swg01_reversal_swings", "d:d swing_no:i direction magnitude:r start_ts:t peak_ts:t peak_price:r",
       "SELECT * FROM x_swings WHERE thr = 30000")
def _(fx):
    return SW.session_swings(fx.index_session, ["d"], 30000)


_LARGEST = "d:d threshold:i direction magnitude:r"


@query("swg02_largest_swing", f"{_LARGEST} start_time:t peak_time:t", "SELECT *, thr AS threshold FROM x_largest")
def _(fx):
    return SW.largest_swings(fx.index_session, ["d"], THRESHOLDS, ZONE_LOW).where("magnitude IS NOT NULL")


@query("swg03_false_starts", "d:d threshold:i false_starts:i", "SELECT *, thr AS threshold FROM x_largest")
def _(fx):
    return SW.largest_swings(fx.index_session, ["d"], THRESHOLDS, ZONE_LOW).where("magnitude IS NOT NULL")


@query("swg04_retracement", "d:d threshold:i retracement:r", "SELECT *, thr AS threshold FROM x_largest")
def _(fx):
    return SW.largest_swings(fx.index_session, ["d"], THRESHOLDS, ZONE_LOW).where("magnitude IS NOT NULL")


@query("swg05_swing_day_features", f"date:d {SWD}", "SELECT * FROM x_swingday")
def _(fx):
    return swing_days(fx)


@query("cal01_calendar_features", "date:d day_of_week week_of_month:i month:i is_expiry_day:b is_no_trade_day:b", "SELECT * FROM x_days")
def _(fx):
    return CAL.calendar_features(fx.index_daily, EXPIRY_CHANGE)


@query("cal02_event_flags", "date:d is_event_day:b event_type event_impact", "SELECT * FROM x_cal")
def _(fx):
    return CAL.event_flags(fx.index_daily.select("date"), fx.event_calendar)


@query("cal03_pre_post_event", f"date:d {CALC}", "SELECT * FROM x_cal")
def _(fx):
    return CAL.day_calendar(fx.index_daily, fx.event_calendar, EXPIRY_CHANGE)


_PCAL = "day_of_week:i day_of_month:i month:i days_to_month_end:i days_to_expiry:i is_expiry_week:i"
PANEL_CAL_SQL = """isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month,
  date_diff('day', date, last_day(date)) AS days_to_month_end,
  date_diff('day', date, last_day(date) - CAST((isodow(last_day(date)) + 3) % 7 AS INTEGER)) AS days_to_expiry,
  CASE WHEN date_diff('day', date, last_day(date) - CAST((isodow(last_day(date)) + 3) % 7 AS INTEGER)) BETWEEN 0 AND 4
    THEN 1 ELSE 0 END AS is_expiry_week"""


@query("cal04_panel_calendar", f"symbol date:d {_PCAL}", f"SELECT symbol, date, {PANEL_CAL_SQL} FROM x_bars")
def _(fx):
    return CAL.panel_calendar(fx.bars_daily.select("symbol", "date"))


@query("mst01_master_day_table", f"{SES} {USED} {VOL} {SWD} {CALC} vix_data_missing:b", "SELECT * FROM x_master")
def _(fx):
    return master(fx)


@query("mst02_load_master", f"{SES} {VOL}", "SELECT * FROM x_master WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'")
def _(fx):
    return D.load_master(master(fx), "1996-01-01", "2000-06-30")


@query("mst02_master_regimes", "vix_regime days:i swing_days:i hits_100:i hits_150:i",
       """SELECT vix_regime, count(*) AS days, count(capture_zone_100) AS swing_days, count(*) FILTER (WHERE capture_zone_100) AS hits_100,
          count(*) FILTER (WHERE capture_zone_150) AS hits_150 FROM x_master GROUP BY 1""")
def _(fx):
    return D.master_regimes(master(fx))


def _nulls(columns):
    return " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)


_GROUPS = {
    "session": ["session_open", "session_high", "session_low", "session_close", "session_range"],
    "dvr_base": ["dvr", "dvr_ratio"],
    "dvr_consumed": [f"dvr_consumed_h{i}" for i in range(1, 7)],
    "vix": ["vix_open", "vix_close", "vix_prev_close", "vix_direction", "vix_change_pct", "vix_downgrade", "vix_regime", "vix_data_missing"],
    "swing": [f"swing_{t}_{f}" for t in THRESHOLDS for f in SW.SWING_FIELDS],
    "capture_zone": ["capture_zone_100", "capture_zone_150"],
    "calendar": ["day_of_week", "week_of_month", "month", "is_expiry_day", "is_no_trade_day", "is_event_day", "is_pre_event", "is_post_event"],
}


@query("mst02_master_nulls", "column_group missing:i",
       " UNION ALL ".join(f"SELECT '{g}' AS column_group, sum({_nulls(c)}) AS missing FROM x_master" for g, c in _GROUPS.items()))
def _(fx):
    return D.master_nulls(master(fx))


_STATS = "days:i mean:r4 median:r4 std:r4 min:r max:r"


def _stats_sql(key):
    return f"""SELECT {key}, count(*) AS days, avg(session_range) AS mean, quantile_cont(session_range, 0.5) AS median,
      stddev_samp(session_range) AS std, min(session_range) AS min, max(session_range) AS max
      FROM (SELECT *, year(date) AS year FROM x_master) WHERE vix_regime IS NOT NULL AND session_range IS NOT NULL GROUP BY 1"""


@query("rng01_range_by_regime", f"vix_regime {_STATS}", _stats_sql("vix_regime"))
def _(fx):
    return D.range_stats(master(fx), "vix_regime")


@query("rng01_range_by_weekday", f"day_of_week {_STATS}", _stats_sql("day_of_week"))
def _(fx):
    return D.range_stats(master(fx), "day_of_week")


@query("rng01_range_by_year", f"year:i {_STATS}", _stats_sql("year"))
def _(fx):
    return D.range_stats(master(fx).withColumn("year", F.year("date")), "year")


_CAPS = (100000, 150000, 200000, 250000)


@query("rng02_capture_feasibility", "vix_regime days:i " + " ".join(f"ge_{t}_count:i ge_{t}_pct:r" for t in _CAPS),
       "SELECT coalesce(vix_regime, 'ALL') AS vix_regime, count(*) AS days, " + ", ".join(
           f"count(*) FILTER (WHERE session_range >= {t}) AS ge_{t}_count, round(count(*) FILTER (WHERE session_range >= {t}) / count(*) * 100, 1) AS ge_{t}_pct"
           for t in _CAPS) + " FROM x_master WHERE vix_regime IS NOT NULL AND session_range IS NOT NULL GROUP BY ROLLUP (vix_regime)")
def _(fx):
    return D.capture_feasibility(master(fx), _CAPS)


@query("rng03_dvr_ratio_by_regime", "vix_regime days:i mean_ratio:r median_ratio:r std_ratio:r",
       """SELECT vix_regime, count(*) AS days, avg(session_range / dvr) AS mean_ratio, quantile_cont(session_range / dvr, 0.5) AS median_ratio,
          stddev_samp(session_range / dvr) AS std_ratio FROM x_master WHERE dvr > 0 AND vix_regime IS NOT NULL GROUP BY 1""")
def _(fx):
    return D.dvr_ratio_by_regime(master(fx))


_MOVES = "days:i ge_low_pct:r ge_high_pct:r median_swing:r4 mean_swing:r4 mean_false_starts:r"
_MOVES_SQL = f"""count(*) AS days, avg(CASE WHEN m >= {ZONE_LOW} THEN 100.0 ELSE 0 END) AS ge_low_pct,
  avg(CASE WHEN m >= {ZONE_HIGH} THEN 100.0 ELSE 0 END) AS ge_high_pct, quantile_cont(m, 0.5) AS median_swing, avg(m) AS mean_swing, avg(f) AS mean_false_starts"""


@query("rng04_swing_by_threshold", f"reversal_threshold:i {_MOVES}",
       f"SELECT reversal_threshold, {_MOVES_SQL} FROM (" + " UNION ALL ".join(
           f"SELECT {t} AS reversal_threshold, swing_{t}_magnitude AS m, swing_{t}_false_starts AS f FROM x_master" for t in THRESHOLDS)
       + ") WHERE m IS NOT NULL GROUP BY 1")
def _(fx):
    return D.swing_by_threshold(master(fx), THRESHOLDS, ZONE_LOW, ZONE_HIGH)


@query("rng04_swing_by_regime", f"vix_regime {_MOVES}",
       f"""SELECT vix_regime, {_MOVES_SQL} FROM (SELECT vix_regime, swing_30000_magnitude AS m, swing_30000_false_starts AS f FROM x_master)
           WHERE m IS NOT NULL AND vix_regime IS NOT NULL GROUP BY 1""")
def _(fx):
    return D.swing_by_regime(master(fx), 30000, ZONE_LOW, ZONE_HIGH)


@query("rng05_directionality", "vix_regime days:i avg_range:r4 avg_swing:r4 directionality:r",
       """SELECT vix_regime, count(*) AS days, avg(session_range) AS avg_range, avg(swing_30000_magnitude) AS avg_swing,
          avg(swing_30000_magnitude / session_range) * 100 AS directionality FROM x_master
          WHERE swing_30000_magnitude > 0 AND session_range > 0 AND vix_regime IS NOT NULL GROUP BY 1""")
def _(fx):
    return D.directionality(master(fx), 30000)


@query("rng06_histogram", "bin:i n:i",
       """SELECT CAST(least(floor((least(r, hi) - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin, count(*) AS n
          FROM (SELECT session_range AS r FROM x_master), (SELECT min(session_range) AS lo, quantile_cont(session_range, 0.99) AS hi FROM x_master)
          GROUP BY 1""")
def _(fx):
    from barlab.operators.aggregates import histogram

    return histogram(master(fx), "session_range", 60, 0.99)
