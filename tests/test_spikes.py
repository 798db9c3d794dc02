"""Price jumps, those from a price of zero among them."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barlab.operators.quality import intraday_spike_rows, spike_rows, spikes

CLOSES = [1.0, 0.0, 2.0, 2.5, 20.0, 0.0, 0.0, None, 3.0]
WANT = [(2, math.inf), (4, 7.0), (6, math.nan)]


@pytest.fixture(scope="module")
def bars(spark):
    start = dt.datetime(2024, 1, 1, 20)
    rows = [("S", start + dt.timedelta(hours=i), i, c) for i, c in enumerate(CLOSES)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, i int, close double").repartition(3)
    return df.select("*", F.col("ts").cast("date").alias("d"), (F.hour("ts") * 60).alias("t"))


@pytest.mark.parametrize("found", [lambda b: intraday_spike_rows(b, 3.0), lambda b: spike_rows(b, 3.0, ["symbol"], "ts")])
def test_moves_from_zero_are_jumps(bars, found):
    got = [(r.i, r.change) for r in found(bars).orderBy("i").collect()]
    assert [i for i, _ in got] == [i for i, _ in WANT]
    assert all(a == b or math.isnan(a) and math.isnan(b) for (_, a), (_, b) in zip(got, WANT, strict=True))


def test_jumps_from_zero_are_counted(bars):
    assert spikes(bars, 3.0, ["symbol"], "ts").first().spikes == len(WANT)
