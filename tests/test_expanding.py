"""Expanding ranks against pandas, with one key that owns half the rows and is cut into many cells."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barlab.functions import expanding


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    out = []
    for key, n in (("hot", 4000), *((f"s{i}", 100 + 7 * i) for i in range(20)), (None, 60), ("one", 1)):
        values = np.round(rng.lognormal(0, 1, n), 3)
        values[rng.random(n) < 0.3] = 1.0  # a heavy value
        values[rng.random(n) < 0.05] = np.nan
        days = np.sort(rng.choice(9000, n, replace=False))
        out += [(key, dt.date(1990, 1, 1) + dt.timedelta(int(d)), None if np.isnan(v) and d % 2 else float(v)) for d, v in zip(days, values, strict=True)]
    return out


def plain(rows, min_rows):
    frame = pd.DataFrame(rows, columns=["k", "o", "v"]).astype({"v": float})
    out = {}
    for key, part in frame.groupby("k", dropna=False):
        part = part.sort_values("o")
        ranks = part["v"].shift(1).expanding(min_periods=min_rows).rank(pct=True)
        out |= {(None if pd.isna(key) else key, o): r for o, r in zip(part["o"], ranks, strict=True) if not np.isnan(r)}
    return out


@pytest.mark.parametrize("held, cuts", [(100_000, 256), (60, 256), (500, 16), (10, 8)])
def test_equals_pandas(spark, rows, monkeypatch, held, cuts):
    monkeypatch.setattr(expanding, "ROWS", held)
    monkeypatch.setattr(expanding, "CUTS", cuts)
    df = spark.createDataFrame(rows, "symbol string, date date, x double").repartition(5)
    found = expanding.expanding_ranks(df, "x", 20, "pct").collect()
    assert sorted((str(r.symbol), r.date) for r in found) == sorted((str(k), o) for k, o, _ in rows)
    got = {(r.symbol, r.date): r.pct for r in found if r.pct is not None}
    want = plain(rows, 20)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_no_group_holds_the_hot_key(spark, rows, monkeypatch):
    monkeypatch.setattr(expanding, "ROWS", 100)
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    ranged = expanding._ranged(expanding._narrow(df, "symbol", "date", "x").where("k = 'hot'")).toPandas()
    assert ranged.groupby("i").size().max() <= 200
    inner = ranged[(ranged["j"] % 2 == 0) & ranged["v"].notna()]
    assert inner.groupby("j").size().max() <= 200
    heavy = ranged[ranged["v"] == 1.0]
    assert len(heavy) > 1000 and (heavy["j"] % 2 == 1).all()


def test_earlier_counts():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (50, 3), (300, 1000), (128, 1)):
        values = rng.integers(0, top, n).astype(float)
        less, equal = expanding.earlier_counts(values)
        assert less.tolist() == [int((values[:t] < values[t]).sum()) for t in range(n)]
        assert equal.tolist() == [int((values[:t] == values[t]).sum()) for t in range(n)]


def test_numbers_and_times_as_order(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(30)], "symbol string, n long, x double")
    by_number = {r.n: r.p for r in expanding.expanding_ranks(df, "x", 2, "p", order="n").collect()}
    timed = df.selectExpr("symbol", "x", "n", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(n as int)) AS ts")
    by_time = {r.ts.minute: r.p for r in expanding.expanding_ranks(timed, "x", 2, "p", order="ts").collect()}
    assert by_number == by_time and by_number[29] is not None
