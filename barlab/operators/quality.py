"""Data-quality checks over whole bar tables: one row per instrument, no per-file loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.chunks import with_previous
from barlab.functions.scalars import minutes, to_minutes
from barlab.functions.scans import Scan, as_number
from barlab.functions.windows import ratio
from barlab.operators.joins import expected_slots
from barlab.session import materialise

PRICES = ("open", "high", "low", "close")
# Expected slots per session run from the open to the close minus one step.
SLOT_STEPS = {"1min": 1, "15min": 15, "60min": 60}
FRAMES = ("1min", "3min", "5min", "15min", "60min")
INSTRUMENT = ("symbol", "asset_type", "timeframe")


def bad_price() -> Column:
    out = F.lit(False)
    for c in PRICES:
        out = out | (F.col(c) <= 0)
    return out


def missing_daily(bars: DataFrame, holidays: DataFrame, key: str = "symbol") -> DataFrame:
    """Weekdays inside an instrument's span, without holidays, that have no bar."""
    days = bars.select(key, F.col("date").alias("d")).distinct()
    spans = days.groupBy(key).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    expected = expected_slots(spans, [key], "lo", "hi", [0], holidays).drop("t")
    return expected.join(days, [key, "d"], "left_anti").withColumnRenamed("d", "date")


def session_slots(timeframe: str, session_open: str = "09:15", session_end: str = "15:30", all_frames: bool = False) -> list[int]:
    """Start minutes of the expected bars; 3- and 5-minute bars are only checked on request."""
    steps = dict(SLOT_STEPS, **({"3min": 3, "5min": 5} if all_frames else {}))
    if timeframe not in steps:
        return []
    step = steps[timeframe]
    return list(range(to_minutes(session_open), to_minutes(session_end) - step + 1, step))


def missing_intraday(bars: DataFrame, holidays: DataFrame, slots: Sequence[int], key: str = "symbol") -> DataFrame:
    """Expected session slots on business days that have no bar."""
    days = bars.select(key, F.col("ts").cast("date").alias("d"), minutes(F.col("ts")).alias("t")).distinct()
    spans = days.groupBy(key).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    if not slots:
        return days.where(F.lit(False))
    return expected_slots(spans, [key], "lo", "hi", slots, holidays).join(days, [key, "d", "t"], "left_anti")


def count_checks(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bad prices and crossed candles."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad_price()).alias("bad_prices"),
        F.count_if(F.col("high") < F.col("low")).alias("corrupt_candles"),
    )


def move(now: Column, before: Column) -> Column:
    """Size of a relative move. From a price of zero it is infinite, or NaN where the price stays zero; both are beyond any threshold."""
    return F.when(before == 0, F.abs(now) * F.lit(float("inf"))).otherwise(F.abs(ratio(now, before) - 1))


def spike_rows(bars: DataFrame, threshold: float, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    change = move(F.col("close"), F.lag("close").over(w))
    return bars.withColumn("change", change).where(F.col("change") > threshold)


def intraday_spike_rows(bars: DataFrame, threshold: float) -> DataFrame:
    """Jumps between neighbouring bars of long series, overnight ones included, one day per window."""
    seen = with_previous(bars, "close", "_prev")
    return seen.withColumn("change", move(F.col("close"), F.col("_prev"))).where(F.col("change") > threshold).drop("_prev")


def spikes(bars: DataFrame, threshold: float, keys: Sequence[str], order: str, shown: int = 10) -> DataFrame:
    """Number of jumps per instrument and the first few times; only those few are collected."""
    hits = spike_rows(bars, threshold, keys, order)
    w = Window.partitionBy(*keys).orderBy(order)
    numbered = hits.withColumn("_n", F.row_number().over(w))
    return numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("spikes"),
        F.sort_array(F.collect_list(F.when(F.col("_n") <= shown, F.col(order)))).alias("first_spikes"),
    )


def duplicate_times(bars: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows beyond the first per time; the repeated times are folded before the key is."""
    per_time = bars.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def validate(bars: DataFrame, holidays: DataFrame, threshold: float = 0.10) -> DataFrame:
    """One report row per instrument: rows, span, every count, the issue texts and whether it is clean."""
    key = ["symbol"]
    base = bars.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(bad_price()).alias("bad_prices"), F.count_if(F.col("high") < F.col("low")).alias("corrupt_candles"),
    )
    parts = [
        missing_daily(bars, holidays).groupBy(*key).agg(F.count(F.lit(1)).alias("missing")),
        spikes(bars, threshold, key, "date").select("symbol", "spikes", "first_spikes"),
        duplicate_times(bars, key, "date"),
    ]
    out = base
    for p in parts:
        out = out.join(p, key, "left")
    out = out.na.fill(0, ["missing", "spikes", "duplicates"])
    return with_issues(out, threshold)


def with_issues(counts: DataFrame, threshold: float, shown: int = 10) -> DataFrame:
    """One sentence per kind of fault found, and whether there is none; needs the counts and ``first_spikes``."""
    def found(count: str, text: str, *tail: Column) -> Column:
        return F.when(F.col(count) > 0, F.concat(F.col(count).cast("string"), F.lit(" " + text), *tail))

    times = F.array_join(F.transform("first_spikes", lambda x: x.cast("string")), ", ")
    cut = F.when(F.col("spikes") > shown, F.lit(f" (first {shown})")).otherwise("")
    faults = [
        found("missing", "expected bars are absent"),
        found("bad_prices", "bars hold a price of zero or less"),
        found("corrupt_candles", "bars have their high under their low"),
        found("spikes", f"closes moved by more than {threshold:.0%}: ", times, cut),
        found("duplicates", "bars repeat the time of another"),
    ]
    if "untimed" in counts.columns:
        faults.append(found("untimed", "rows have no time"))
    return counts.withColumn("issues", F.array_compact(F.array(*faults))).withColumn("clean", F.size("issues") == 0)


def day_counts(bars: DataFrame, threshold: float, session_open: str = "09:15", session_end: str = "15:30") -> DataFrame:
    """One row per instrument and day with everything the report needs, from one exchange of the bars.

    ``on_grid`` counts the different session slots that have a bar (one for a daily bar). Jumps inside the day are
    counted here; the first and the last close are kept for the jump over night. Bars of equal time are ordered by close.
    """
    day = [*INSTRUMENT, "d"]
    w = Window.partitionBy(*day).orderBy("ts", "close")
    first, last = F.col("_before").isNull(), F.lead("ts").over(w).isNull()
    minute = minutes(F.col("ts"))
    start, end = to_minutes(session_open), to_minutes(session_end)
    step = F.create_map(*[F.lit(x) for pair in SLOT_STEPS.items() for x in pair])[F.col("timeframe")]
    on_slot = (minute >= start) & (minute <= end - step) & ((minute - start) % step == 0) & (F.date_trunc("minute", "ts") == F.col("ts"))
    seen = (
        bars.where("ts IS NOT NULL").withColumn("d", F.col("ts").cast("date"))
        .withColumns({"_before": F.lag("ts").over(w), "_close": F.lag("close").over(w), "_last": last})
        .withColumns({
            "_repeat": F.coalesce(F.col("_before") == F.col("ts"), F.lit(False)),
            "_jump": F.abs(ratio(F.col("close"), F.col("_close")) - 1) > threshold,
        })
    )
    slot = F.when(F.col("timeframe") == "daily", first).otherwise(on_slot & ~F.col("_repeat"))
    return seen.groupBy(*day).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(bad_price()).alias("bad_prices"), F.count_if(F.col("high") < F.col("low")).alias("corrupt_candles"),
        F.count_if("_repeat").alias("duplicates"), F.count_if(slot).alias("on_grid"), F.count_if("_jump").alias("spikes"),
        F.max(F.when(first, F.col("close"))).alias("open_close"), F.max(F.when(F.col("_last"), F.col("close"))).alias("last_close"),
        F.array_sort(F.collect_list(F.when(F.col("_jump"), F.col("ts")))).alias("jumps"),
    )


def expected_bars(spans: DataFrame, holidays: DataFrame, session_open: str = "09:15", session_end: str = "15:30") -> DataFrame:
    """Business days of each instrument's span and how many bars a day should have; null for timeframes without a grid."""
    per_day = {"daily": 1, **{f: len(session_slots(f, session_open, session_end)) for f in SLOT_STEPS}}
    slots = F.create_map(*[F.lit(x) for pair in per_day.items() for x in pair])[F.col("timeframe")]
    days = spans.select(*INSTRUMENT, F.explode(F.sequence(F.col("first_ts").cast("date"), F.col("last_ts").cast("date"))).alias("d"))
    business = days.where(F.weekday("d") < 5).join(holidays.select(F.col("date").alias("d")).distinct(), "d", "left_anti")
    return business.withColumn("slots", slots)


def batch_report(bars: DataFrame, instruments: DataFrame, holidays: DataFrame, threshold: float = 0.10, shown: int = 10) -> DataFrame:
    """The report of ``validate`` for any list of (symbol, asset_type, timeframe), daily and intraday together.

    Every listed instrument gets exactly one row, whatever state its bars are in; repeated list rows count once.
    Without bars (or a name that is null) the row has zero rows, ``clean`` false and the reason as its only issue. Bars without a
    time are counted in ``rows`` and reported; they take no part in the other checks but the price checks. Daily
    series are checked against business days, 1-, 15- and 60-minute series against the session's slots, other
    timeframes only for the remaining faults. A series of one bar has no gaps. Jumps include those from the last
    close of a day to the first of the next; a change from zero or null is none.
    """
    wanted = instruments.select(*INSTRUMENT).distinct()
    bars = bars.select(*INSTRUMENT, "ts", *PRICES).join(wanted, list(INSTRUMENT), "left_semi")
    untimed = bars.where("ts IS NULL").groupBy(*INSTRUMENT).agg(
        F.count(F.lit(1)).alias("untimed"), F.count_if(bad_price()).alias("_bad"), F.count_if(F.col("high") < F.col("low")).alias("_crossed"))
    days = materialise(day_counts(bars, threshold), "report_days")
    by_day = Window.partitionBy(*INSTRUMENT).orderBy("d")
    night = F.abs(ratio(F.col("open_close"), F.lag("last_close").over(by_day)) - 1) > threshold
    days = days.withColumn("jumps", F.when(night, F.concat(F.array("first_ts"), "jumps")).otherwise(F.col("jumps")))
    totals = days.groupBy(*INSTRUMENT).agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        *[F.sum(c).alias(c) for c in ("rows", "bad_prices", "corrupt_candles", "duplicates")], F.sum(F.size("jumps")).alias("spikes"))
    # a few times per instrument: at most ten a day enter the ranking, at most ten are gathered
    times = days.select(*INSTRUMENT, F.explode(F.slice("jumps", 1, shown)).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(*INSTRUMENT).orderBy("_at"))
    first_times = times.withColumn("_n", nth).where(F.col("_n") <= shown).groupBy(*INSTRUMENT).agg(
        F.array_sort(F.collect_list("_at")).alias("first_spikes"))
    due = expected_bars(totals, holidays).join(days.select(*INSTRUMENT, "d", "on_grid"), [*INSTRUMENT, "d"], "left")
    gaps = due.groupBy(*INSTRUMENT).agg(F.sum(F.col("slots") - F.coalesce("on_grid", F.lit(0))).alias("missing"))
    out = wanted
    for part in (totals, untimed, first_times, gaps):
        out = out.join(part, list(INSTRUMENT), "left")
    filled = out.na.fill(0, ["rows", "untimed", "_bad", "_crossed", "bad_prices", "corrupt_candles", "duplicates", "spikes", "missing"])
    filled = filled.withColumns({
        "missing": F.when(F.col("rows") < 2, 0).otherwise(F.col("missing")), "rows": F.col("rows") + F.col("untimed"),
        "bad_prices": F.col("bad_prices") + F.col("_bad"), "corrupt_candles": F.col("corrupt_candles") + F.col("_crossed"),
        "first_spikes": F.coalesce("first_spikes", F.array().cast("array<timestamp_ntz>")),
    }).drop("_bad", "_crossed")
    report = with_issues(filled, threshold, shown)
    known = F.coalesce(F.col("timeframe").isin("daily", *FRAMES), F.lit(False))
    reason = F.when(known, F.lit("no bars are stored")).otherwise(F.lit("no bars are stored and the timeframe is unknown"))
    empty = F.col("rows") == 0
    return report.withColumns({
        "issues": F.when(empty, F.array(reason)).otherwise(F.col("issues")), "clean": F.col("clean") & ~empty,
    })


def ohlc_consistency(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in PRICES)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(h < low).alias("high_lt_low"), F.count_if(h < o).alias("high_lt_open"),
        F.count_if(h < c).alias("high_lt_close"), F.count_if(low > o).alias("low_gt_open"), F.count_if(low > c).alias("low_gt_close"),
        F.count_if(bad_price()).alias("price_le_0"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )


def completeness(inventory: DataFrame, symbols: DataFrame, minima: dict[str, int], late_after: str) -> DataFrame:
    """Per expected (symbol, timeframe): missing, low on rows, or starting late (daily only)."""
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("timeframe"), F.lit(n).alias("min_rows")) for t, n in minima.items()]))
    expected = symbols.select("symbol").distinct().select("symbol", wanted.alias("_w")).select("symbol", "_w.*")
    out = expected.join(inventory.select("symbol", "timeframe", "rows", "first_ts"), ["symbol", "timeframe"], "left")
    late = (F.col("timeframe") == "daily") & (F.col("first_ts").cast("date") > F.lit(late_after).cast("date"))
    return out.withColumns({
        "missing": F.col("rows").isNull(), "low_rows": F.coalesce(F.col("rows") < F.col("min_rows"), F.lit(False)),
        "late_start": F.coalesce(late, F.lit(False)),
    })


def cross_timeframe(daily: DataFrame, intraday: DataFrame, max_day_gap: int = 20, max_diff: float = 0.01) -> DataFrame:
    """Distinct-day counts of two timeframes, and the last daily close against the last intraday close of that day."""
    d = daily.groupBy("symbol").agg(
        F.count_distinct("d").alias("daily_days"), F.max("d").alias("last_d"), F.max_by("close", "d").alias("daily_close")
    )
    per_day = intraday.groupBy("symbol", "d").agg(F.max_by("close", "ts").alias("intraday_close"))
    i = per_day.groupBy("symbol").agg(F.count(F.lit(1)).alias("intraday_days"))
    out = d.join(i, "symbol", "left").join(per_day.withColumnRenamed("d", "last_d"), ["symbol", "last_d"], "left")
    diff = F.abs(F.col("daily_close") - F.col("intraday_close")) / F.col("daily_close")
    return out.withColumns({
        "day_gap": F.abs(F.col("daily_days") - F.coalesce("intraday_days", F.lit(0))), "close_diff": diff,
        "days_differ": F.abs(F.col("daily_days") - F.coalesce("intraday_days", F.lit(0))) > max_day_gap,
        "close_differs": F.coalesce(diff > max_diff, F.lit(False)),
    })


def file_integrity(bars: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Null prices, smallest price, crossed candles, distinct days and bars outside market hours."""
    nulls = F.lit(0)
    for c in PRICES:
        nulls = nulls + F.col(c).isNull().cast("int")
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(nulls).alias("null_prices"), F.min(F.least(*PRICES)).alias("min_price"),
        F.count_if(F.col("high") < F.col("low")).alias("crossed"), F.count_distinct(F.col(ts).cast("date")).alias("days"),
        F.count_if((F.hour(ts) < 9) | (F.hour(ts) >= 16)).alias("outside_hours"),
    )


def unsorted_rows(stored: DataFrame, keys: Sequence[str], position: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows whose time lies before that of the stored row ahead of them, for keys of any size."""
    rows = stored.select(*keys, *position, F.col(ts).alias("_ts"))
    seen = Scan(rows, keys, as_number(rows, position[0]), position[1:]).add(_ahead=("previous", F.col("_ts"))).result()
    return seen.groupBy(*keys).agg(F.count_if(F.col("_ahead") > F.col("_ts")).alias("out_of_order"))


def rows_per_year(bars: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    return bars.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(ts).cast("date")).alias("days")
    )


def detect_corporate_actions(bars: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Opens far from the previous close, with display rounding (half to even)."""
    w = Window.partitionBy("symbol").orderBy("date")
    found = bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("ratio", ratio(F.col("open"), F.col("prev_close")))
    out = found.where((F.col("ratio") < 1 - threshold) | (F.col("ratio") > 1 + threshold))
    return out.select(
        "symbol", "date", F.bround("ratio", 4).alias("ratio"),
        *[F.bround(c, 2).alias(c) for c in ("prev_close", "open", "close")],
    )


def spot_check(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """Closes on known dates against their expected band."""
    out = expected.join(bars.select("symbol", "date", "close"), ["symbol", "date"], "left")
    return out.withColumn("ok", F.coalesce(F.col("close").between(F.col("low_bound"), F.col("high_bound")), F.lit(False)))


def bars_per_day(bars: DataFrame) -> DataFrame:
    """Mean, smallest and largest number of bars per day."""
    per_day = bars.groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy("symbol").agg(F.avg("n").alias("mean_bars"), F.min("n").alias("min_bars"), F.max("n").alias("max_bars"))


def freshness(bars: DataFrame, keys: Sequence[str], as_of: Column, max_age_days: int = 7) -> DataFrame:
    out = bars.groupBy(*keys).agg(F.max(F.col("ts").cast("date")).alias("last_date"))
    age = F.datediff(as_of, F.col("last_date"))
    return out.withColumn("age_days", age).withColumn("stale", F.col("age_days") > max_age_days)
