"""Swings, level breaks and barriers against plain state machines."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions.scalars import to_minutes
from barlab.operators import geometry as G
from barlab.operators import trades as TR
from barlab.operators.swings import session_swings, swing_day_features
from tests.test_series import bars


def session(spark, closes, start="2024-01-01 09:15"):
    rows = [((pd.Timestamp(start) + pd.Timedelta(minutes=i)).to_pydatetime(), float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, close double")
    return df.select(F.col("ts").cast("date").alias("d"), "ts", F.col("close").alias("high"), F.col("close").alias("low"), "close")


@pytest.mark.parametrize("closes, want", [
    ([100, 110, 130, 160], [("up", 60)]),
    ([100, 150, 120, 90, 120, 140], [("up", 50), ("down", 60), ("up", 50)]),
    ([100, 100, 100], []),
    ([100], []),
])
def test_swings_by_eye(spark, closes, want):
    got = session_swings(session(spark, closes), ["d"], 30).orderBy("swing_no").collect()
    assert [(r["direction"], r["magnitude"]) for r in got] == want


def test_swing_day_row_without_swings(spark):
    row = swing_day_features(session(spark, [100, 100]), ["d"]).first()
    assert row["swing_30_magnitude"] is None and row["swing_30_false_starts"] == 0 and row["capture_zone_100"] is False


def loop_breaks(day, k, lo, hi):
    o, h, low, c, t = (day[x].to_numpy() for x in ("open", "high", "low", "close", "t"))
    level, out = {"long": None, "short": None}, []
    for i in range(len(day)):
        j = i - k
        if j >= k:
            around_h = np.concatenate([h[j - k:j], h[j + 1:j + k + 1]])
            around_l = np.concatenate([low[j - k:j], low[j + 1:j + k + 1]])
            if (h[j] > around_h).all():
                level["long"] = max(o[j], c[j])
            if (low[j] < around_l).all():
                level["short"] = min(o[j], c[j])
        if not lo <= t[i] <= hi:
            continue
        for side in ("long", "short"):
            price = level[side]
            if price is not None and (c[i] > price if side == "long" else c[i] < price):
                out.append((side, i, round(float(price), 9)))
                level[side] = None
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_level_breaks_against_a_loop(spark, seed):
    df = bars(spark, 750, seed=seed)
    found = G.triggers(G.indicators(df), [1, 2], "10:00", "13:30").toPandas()
    whole = df.toPandas().sort_values(["symbol", "ts"])
    for k in (1, 2):
        got = {(r.symbol, r.date, r.direction, r.bar_index, round(r.level_price, 9)) for r in found[found.k == k].itertuples()}
        want = {
            (s, d, *x) for (s, d), day in whole.groupby(["symbol", "d"])
            for x in loop_breaks(day, k, to_minutes("10:00"), to_minutes("13:30"))
        }
        assert got == want and want


def walk(trade, later, cfg, breakeven):
    long = trade.direction == "long"
    sign = 1.0 if long else -1.0
    armed = False
    for b in later.itertuples():
        if b.t >= to_minutes(cfg.force_close):
            return "time", b.open, sign * (b.open - trade.entry_price) / trade.R_unit, False
        stop = trade.entry_price if armed else trade.stop_price
        hit_stop = b.low <= stop if long else b.high >= stop
        hit_goal = b.high >= trade.target_price if long else b.low <= trade.target_price
        if hit_stop:
            return ("breakeven" if armed else "stop"), stop, sign * (stop - trade.entry_price) / trade.R_unit, bool(hit_goal)
        if hit_goal:
            return "target", trade.target_price, cfg.target_r, False
        if breakeven and (b.high >= trade.be_price if long else b.low <= trade.be_price):
            armed = True
    last = later["close"].iloc[-1] if len(later) else trade.entry_price
    return "time", last, sign * (last - trade.entry_price) / trade.R_unit, False


@pytest.mark.parametrize("breakeven", [False, True])
def test_barriers_against_a_walk(spark, breakeven):
    df = bars(spark, 1500, seed=9)
    cfg = TR.TradeConfig(huge_mult=50, stop_max=0.5, target_r=1.2, breakeven_r=0.6, force_close="14:30")
    ready = TR.prepare(G.triggers(G.indicators(df), [1], "09:30", "14:45"), df, cfg)
    done = TR.resolve(ready, df, cfg, breakeven).where("qual_stop AND R_unit > 0").toPandas()
    whole = df.toPandas()
    seen = set()
    for r in done.itertuples():
        later = whole[(whole.symbol == r.symbol) & (whole.d == r.date) & (whole.t > r.trigger_t)].sort_values("t")
        reason, price, gained, tie = walk(r, later, cfg, breakeven)
        assert (r.exit_reason, bool(r.tie_stopfirst)) == (reason, tie)
        assert r.exit_price == pytest.approx(price) and r.realized_R == pytest.approx(gained)
        seen.add(reason)
    assert seen >= ({"time", "stop", "target", "breakeven"} if breakeven else {"time", "stop", "target"})


def one_trade(spark, candles, direction="long"):
    trade = spark.createDataFrame(
        [("S", pd.Timestamp("2024-01-01").date(), 1, direction, 600, 100.0, 99.0, 103.0, 102.0, 1.0, True)],
        "symbol string, date date, k int, direction string, trigger_t int, entry_price double, stop_price double, target_price double, "
        "be_price double, R_unit double, qual_stop boolean",
    )
    rows = [("S", pd.Timestamp("2024-01-01").date(), 600 + 5 * i, *map(float, c)) for i, c in enumerate(candles)]
    return trade, spark.createDataFrame(rows, "symbol string, d date, t int, open double, high double, low double, close double")


@pytest.mark.parametrize("candles, breakeven, want", [
    ([(100, 100, 100, 100), (100, 104, 98, 100)], False, ("stop", -1.0, True)),
    ([(100, 100, 100, 100), (100, 102.5, 98, 100)], True, ("stop", -1.0, False)),
    ([(100, 100, 100, 100), (101, 102.5, 100.5, 102), (101, 101, 99.5, 100)], True, ("breakeven", 0.0, False)),
    ([(100, 100, 100, 100), (101, 101, 100.5, 101)], False, ("time", 1.0, False)),
    ([(100, 100, 100, 100)], False, ("time", 0.0, False)),
])
def test_barriers_by_eye(spark, candles, breakeven, want):
    trade, later = one_trade(spark, candles)
    r = TR.resolve(trade, later, TR.TradeConfig(), breakeven).first()
    assert (r["exit_reason"], r["realized_R"], r["tie_stopfirst"]) == want


def test_forced_bar_that_also_touches_exits_at_its_open(spark):
    trade, later = one_trade(spark, [(100, 100, 100, 100), (101, 105, 90, 95)])
    r = TR.resolve(trade, later, TR.TradeConfig(force_close="10:05")).first()
    assert (r["exit_reason"], r["exit_price"]) == ("time", 101.0)


@pytest.mark.parametrize("rows, want", [
    ([], []),
    ([("A", None)], [("A", None)]),
    ([("A", -1.0), ("B", None)], [("A", -1.0)]),
    ([("A", 0.5), ("C", 0.5), ("B", 0.2)], [("C", 0.5)]),
])
def test_best_variant_without_trades_is_no_row(spark, rows, want):
    got = TR.best_variant(spark.createDataFrame(rows, "filter string, expectancy_R double"), "filter").collect()
    assert [tuple(r) for r in got] == want
