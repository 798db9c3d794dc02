"""Whole-table replaces, the shared folder, and smoothing in chunks against a plain loop."""

import datetime as dt
import random

import pytest

from barlab.operators.geometry import indicators
from barlab.session import shared_dir
from barlab.sources import bars as B


def _bars(spark, years):
    rows = [("A", dt.datetime(y, 3, 1), 1.0, 2.0, 0.5, 1.5, 10) for y in years]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def test_write_bars_leaves_no_stale_year(spark, tmp_path):
    root = str(tmp_path / "bars")
    B.write_bars(_bars(spark, [2020, 2021]), root, "stock", "daily")
    B.write_bars(_bars(spark, [2019]), root, "index", "daily")
    B.write_bars(_bars(spark, [2020]), root, "stock", "daily")
    got = spark.read.schema(B.BAR_SCHEMA).parquet(root).groupBy("asset_type", "year").count().collect()
    assert sorted((r.asset_type, r.year) for r in got) == [("index", 2019), ("stock", 2020)]


def test_write_years_keeps_other_years(spark, tmp_path):
    root = str(tmp_path / "bars")
    B.write_bars(_bars(spark, [2020, 2021]), root, "stock", "daily")
    B.write_years(_bars(spark, [2021, 2022]), root, "stock", "daily")
    got = spark.read.schema(B.BAR_SCHEMA).parquet(root).groupBy("year").count().collect()
    assert sorted((r.year, r["count"]) for r in got) == [(2020, 1), (2021, 1), (2022, 1)]


def test_write_rs_leaves_no_stale_benchmark(spark, tmp_path):
    root = str(tmp_path / "rs")
    rows = [("A", dt.datetime(2020, 1, 1), "sector", 1.0, "5min", b) for b in ("X", "Y")]
    rs = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, membership_type string, rs_value double, timeframe string, benchmark_index string")
    B.write_rs(rs, root)
    B.write_rs(rs.where("benchmark_index = 'X'"), root)
    assert [r.benchmark_index for r in B.read_rs(spark, root).collect()] == ["X"]


class _Remote:
    class conf:
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)


def test_shared_folder_is_required_on_a_cluster(spark):
    assert shared_dir(spark)
    with pytest.raises(RuntimeError):
        shared_dir(_Remote())


@pytest.mark.parametrize("period", [14, 100, 250])
def test_atr_does_not_depend_on_chunks(spark, period):
    rng, n, price, rows = random.Random(period), 30_000, 100.0, []
    for i in range(n):
        low, high = price - rng.random(), price + rng.random()
        # an early shock that a short halo would still feel
        high += 1e6 if i == 5 else 0
        rows.append(("S", dt.date(2020, 1, 1) + dt.timedelta(days=i // 100), dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), price, high, low, price, 1))
        price += rng.random() - 0.5
    bars = spark.createDataFrame(rows, "symbol string, d date, ts timestamp_ntz, open double, high double, low double, close double, volume long")
    got = {r.pos: (r.atr, r.avg_range) for r in indicators(bars, period, 3, chunk_rows=1024).select("pos", "atr", "avg_range").collect()}
    true, close, atr = [], None, None
    for i, (_, _, _, _, high, low, c, _) in enumerate(rows):
        true.append(max(high - low, *((abs(high - close), abs(low - close)) if close is not None else (0.0,))))
        close = c
        if i == period - 1:
            atr = sum(true) / period
        elif i >= period:
            atr += (true[-1] - atr) / period
        if atr is not None and i % 97 == 0:
            assert got[i][0] == pytest.approx(atr, rel=1e-9)
            mean = sum(r[4] - r[5] for r in rows[i - period + 1 : i + 1]) / period
            assert got[i][1] == pytest.approx(mean, rel=1e-6)
    assert len(got) == n
