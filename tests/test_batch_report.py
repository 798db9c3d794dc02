"""The batch report against plain loops, and its rows for instruments in a bad state."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barlab.operators.quality import SLOT_STEPS, batch_report, session_slots

SCHEMA = "symbol string, asset_type string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double"
LIST = "symbol string, asset_type string, timeframe string"
HOLIDAY = dt.date(2024, 1, 10)


def holidays(spark):
    return spark.createDataFrame([(HOLIDAY,)], "date date")


def series(rng, frame, days):
    """Bars of business days with gaps, repeats, stray times, bad prices and jumps; duplicates may differ in close."""
    rows = []
    for i in range(days):
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
        times = [day] if frame == "daily" else [day + dt.timedelta(minutes=m) for m in session_slots(frame)] + [day + dt.timedelta(hours=16)]
        if day.weekday() >= 5 and rng.random() < 0.7:
            continue
        for t in times:
            if rng.random() < 0.1:
                continue
            for _ in range(2 if rng.random() < 0.05 else 1):
                o, c = rng.choice([10.0, 11.0, 30.0]), rng.choice([10.0, 10.5, 40.0, 0.0])
                rows.append((t, o, rng.choice([50.0, 5.0]), rng.choice([9.0, -1.0]), c))
    return rows


def expected(rows, frame, threshold):
    rows = sorted(rows, key=lambda r: (r[0], r[4]))
    closes = [r[4] for r in rows]
    jumps = [rows[i][0] for i in range(1, len(rows)) if closes[i - 1] and abs(closes[i] / closes[i - 1] - 1) > threshold]
    seen = {r[0] for r in rows}
    missing, day = 0, rows[0][0].date()
    while len(rows) > 1 and day <= rows[-1][0].date():
        if day.weekday() < 5 and day != HOLIDAY:
            start = dt.datetime.combine(day, dt.time())
            due = [start] if frame == "daily" else [start + dt.timedelta(minutes=m) for m in session_slots(frame)]
            missing += sum(t not in seen for t in due)
        day += dt.timedelta(days=1)
    return {
        "rows": len(rows), "first_ts": rows[0][0], "last_ts": rows[-1][0], "missing": missing, "spikes": len(jumps), "first_spikes": jumps[:10],
        "bad_prices": sum(min(r[1:]) <= 0 for r in rows), "corrupt_candles": sum(r[2] < r[3] for r in rows), "duplicates": len(rows) - len(seen),
    }


def test_counts_match_plain_loops(spark):
    rng = random.Random(5)
    made = {(f"S{i}", "stock", f): series(rng, f, days) for i, (f, days) in enumerate(
        [("daily", 60), ("60min", 25), ("15min", 12), ("1min", 4), ("daily", 3)])}
    bars = spark.createDataFrame([(*k, *r) for k, rows in made.items() for r in rows], SCHEMA).repartition(7)
    wanted = spark.createDataFrame(list(made) + list(made)[:2], LIST)
    got = {(r.symbol, r.asset_type, r.timeframe): r for r in batch_report(bars, wanted, holidays(spark), 0.5).collect()}
    assert set(got) == set(made)
    for k, rows in made.items():
        for name, value in expected(rows, k[2], 0.5).items():
            assert got[k][name] == value, (k, name)
        assert got[k]["clean"] == (not got[k]["issues"])


def test_instruments_in_a_bad_state_are_rows_not_errors(spark):
    t = dt.datetime(2024, 1, 2, 9, 15)
    rows = [
        ("ONE", "stock", "60min", t, 1.0, 1.0, 1.0, 1.0),                                   # one bar: no gaps
        ("NOTIME", "stock", "daily", None, 0.0, 1.0, 1.0, 1.0),                            # no time, a bad price
        ("NULLS", "stock", "daily", dt.datetime(2024, 1, 2), None, None, None, None),
        ("NULLS", "stock", "daily", dt.datetime(2024, 1, 3), None, None, None, None),
        ("ODD", "stock", "7min", t, 1.0, 1.0, 1.0, 1.0), ("ODD", "stock", "7min", t + dt.timedelta(days=2), 1.0, 1.0, 1.0, 1.0),
        ("SIX", "stock", "60min", t.replace(second=1), 1.0, 1.0, 1.0, 1.0), ("SIX", "stock", "60min", t + dt.timedelta(hours=1), 1.0, 1.0, 1.0, 1.0),
        (None, "stock", "daily", t, 1.0, 1.0, 1.0, 1.0),
        ("UNLISTED", "stock", "daily", t, -1.0, 1.0, 1.0, 1.0),
    ]
    names = ["ONE", "NOTIME", "NULLS", "ODD", "SIX", "GHOST", None]
    frames = {"ONE": "60min", "ODD": "7min", "SIX": "60min"}
    wanted = spark.createDataFrame([(n, "stock", frames.get(n, "daily")) for n in names] + [("GHOST", "stock", "2min"), ("GHOST", "stock", None)], LIST)
    report = batch_report(spark.createDataFrame(rows, SCHEMA), wanted, holidays(spark)).collect()
    assert len(report) == 9
    got = {(r.symbol, r.timeframe): r for r in report}
    assert got["ONE", "60min"].clean and got["ONE", "60min"].missing == 0
    assert (got["NOTIME", "daily"].rows, got["NOTIME", "daily"].bad_prices, got["NOTIME", "daily"].first_ts) == (1, 1, None)
    assert got["NOTIME", "daily"].issues == ["1 bars hold a price of zero or less", "1 rows have no time"]
    assert got["NULLS", "daily"].clean and got["NULLS", "daily"].rows == 2
    assert got["ODD", "7min"].clean and got["ODD", "7min"].missing == 0
    assert got["SIX", "60min"].missing == len(session_slots("60min")) - 1   # a second past the slot is not the slot
    for key, text in {("GHOST", "daily"): "no bars are stored", (None, "daily"): "no bars are stored",
                      ("GHOST", "2min"): "no bars are stored and the timeframe is unknown"}.items():
        assert (got[key].rows, got[key].clean, got[key].issues) == (0, False, [text])
    assert not got["GHOST", None].clean


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("A", "stock", "daily")], LIST)
    row = batch_report(nothing, one, holidays(spark)).first()
    assert (row.rows, row.missing, row.first_spikes, row.clean) == (0, 0, [], False)
    assert batch_report(nothing, one.where(F.lit(False)), holidays(spark)).count() == 0


def test_a_clean_series_of_every_grid(spark):
    rows = []
    for f in ("daily", *SLOT_STEPS):
        for day in (dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 12)):
            times = [day] if f == "daily" else [day + dt.timedelta(minutes=m) for m in session_slots(f)]
            rows += [("A", "index", f, t, 1.0, 2.0, 0.5, 1.0) for t in times]
    bars = spark.createDataFrame(rows, SCHEMA)
    report = batch_report(bars, bars.select("symbol", "asset_type", "timeframe"), holidays(spark)).collect()
    assert len(report) == 4 and all(r.clean and r.issues == [] for r in report)
