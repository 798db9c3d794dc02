"""Windows over (symbol, date) and chunked look-back against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions import windows as W
from barlab.operators import geometry as G
from barlab.operators.labels import contamination_by_position, event_within
from barlab.operators.panel import expanding_rank, window_families
from barlab.operators.sets import drawdown, longest_streak


def days(spark, values, symbol="S"):
    rows = [(symbol, i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, i int, x double")
    return df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")))


def test_roll_counts_non_null_rows(spark):
    df = days(spark, [1, None, 3, 4, None, 6])
    w = W.series()
    got = [r[0] for r in df.select(W.roll(F.avg, F.col("x"), 3, 2, w).alias("m")).collect()]
    want = pd.Series([1, None, 3, 4, None, 6]).rolling(3, min_periods=2).mean().tolist()
    assert [None if pd.isna(v) else v for v in want] == got


def test_expanding_rank_with_ties_and_a_null(spark):
    rng = np.random.default_rng(1)
    values = list(rng.integers(0, 9, 65).astype(float))
    values[20] = None
    got = [r["r"] for r in expanding_rank(days(spark, values), "x", 60, "r").orderBy("i").collect()]
    want = pd.Series(values, dtype=float).shift(1).expanding(min_periods=60).rank(pct=True)
    assert [None if pd.isna(v) else pytest.approx(v) for v in want] == got
    # the same by counting
    history = [v for v in values[:64] if v is not None]
    y = values[63]
    assert got[64] == pytest.approx((sum(v < y for v in history) + (sum(v == y for v in history) + 1) / 2) / len(history))


def test_streak_breaks_on_zero_and_drawdown(spark):
    df = days(spark, [3, -1, -1, 0, -1, -1, -1])
    assert longest_streak(df, [], ["date"], F.col("x") < 0).first()[0] == 3
    curve = drawdown(df, [], ["date"], "x").orderBy("date").collect()
    assert [r["drawdown"] for r in curve] == [0, 1, 2, 2, 3, 4, 5]


def test_event_within_is_false_past_the_end(spark):
    df = days(spark, [0, 0, 1, 0, 1])
    got = [r[0] for r in df.withColumn("e", event_within(F.col("x") == 1, 2, W.series())).orderBy("i").select("e").collect()]
    assert got == [True, True, True, False, False]


@pytest.mark.parametrize("seed", range(3))
def test_contamination_against_positions(spark, seed):
    rng = np.random.default_rng(seed)
    have = sorted(rng.choice(80, 50, replace=False).tolist())
    ex = sorted(rng.choice(80, 4, replace=False).tolist())
    day = lambda i: pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(i))
    df = spark.createDataFrame([("S", day(i).date(), i) for i in have], "symbol string, date date, i int")
    actions = spark.createDataFrame([("S", day(i).date()) for i in ex], "symbol string, ex_date date")
    got = {r["i"] for r in contamination_by_position(df, actions, 6, "date").where("contaminated").collect()}
    want = set()
    for e in ex:
        p = next((n for n, i in enumerate(have) if i >= e), None)
        if p is not None:
            want |= set(have[p:p + (7 if have[p] == e else 6)])
    assert got == want


def bars(spark, n, seed=0, symbols=("A", "B"), per_day=25):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(n):
            o = price + rng.normal(0, 1)
            c = o + rng.normal(0, 1)
            h, low = max(o, c) + abs(rng.normal(0, 0.5)), min(o, c) - abs(rng.normal(0, 0.5))
            ts = pd.Timestamp("2024-01-01 09:00") + pd.Timedelta(days=i // per_day, minutes=15 * (i % per_day))
            rows.append((s, ts.to_pydatetime(), o, h, low, c, 10))
            price = c
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    return df.withColumn("d", F.col("ts").cast("date")).withColumn("t", F.hour("ts") * 60 + F.minute("ts"))


def test_atr_is_the_same_in_one_chunk_and_in_many(spark):
    df = bars(spark, 2600).repartition(8)
    many = G.indicators(df, 14, 3, chunk_rows=640).toPandas().sort_values(["symbol", "ts"])
    for _, part in many.groupby("symbol"):
        h, low, c = part["high"].to_numpy(), part["low"].to_numpy(), part["close"].to_numpy()
        prev = np.concatenate([[np.nan], c[:-1]])
        tr = np.nanmax(np.stack([h - low, abs(h - prev), abs(low - prev)]), axis=0)
        atr = np.full(len(tr), np.nan)
        atr[13] = tr[:14].mean()
        for i in range(14, len(tr)):
            atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
        np.testing.assert_allclose(part["tr"], tr, rtol=1e-12)
        np.testing.assert_allclose(part["atr"], atr, rtol=1e-11)
        np.testing.assert_allclose(part["atr_prev"].to_numpy()[1:], atr[:-1], rtol=1e-11)
        np.testing.assert_allclose(part["avg_range"], pd.Series(h - low).rolling(14).mean(), rtol=1e-9)
        np.testing.assert_allclose(part["low_back"].to_numpy()[3:], low[:-3])
        assert len(part) == 2600


def test_no_feature_sees_the_future(spark):
    df = bars(spark, 160, per_day=1).select("symbol", F.col("d").alias("date"), "open", "high", "low", "close", "volume")
    cut = "2024-04-10"
    whole = window_families(df).where(F.col("date") <= cut)
    known = window_families(df.where(F.col("date") <= cut))
    assert whole.exceptAll(known).count() == 0 and known.exceptAll(whole).count() == 0
