"""Running values by ranges against pandas; one key owns most rows and is spread over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.scans import Scan, as_number
from barlab.operators.aggregates import cumulative_share
from barlab.operators.quality import unsorted_rows
from barlab.operators.sets import drawdown, longest_streak


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    n = 5000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))
    place = rng.integers(0, 900, n)  # many ties
    value = np.round(rng.normal(0, 10, n), 1)
    rows = [(None if k == "b" else str(k), int(p), i, None if i % 11 == 0 else float(v)) for i, (k, p, v) in enumerate(zip(key, place, value, strict=True))]
    return spark.createDataFrame(rows, "k string, p int, id long, v double").repartition(7)


def test_every_operation_equals_pandas(table):
    scan = Scan(table, ["k"], F.col("p"), ["id"], parts=32)
    assert scan.rows.where("k = 'hot'").select("_part").distinct().count() > 20
    got = scan.add(
        total=("sum", F.col("v")), top=("max", F.col("v")), least=("min", F.col("v")), known=("last", F.col("v")), before=("previous", F.col("v"))
    ).result().toPandas()
    for _, part in got.fillna({"k": "-"}).groupby("k"):
        part = part.sort_values(["p", "id"])
        v = part["v"]
        assert np.allclose(part["total"].fillna(0), v.fillna(0).cumsum())
        assert part["top"].equals(v.cummax().ffill()) and part["least"].equals(v.cummin().ffill())
        assert part["known"].equals(v.ffill()) and part["before"].equals(v.shift(1))


def test_without_keys_and_on_an_empty_table(table):
    got = Scan(table, [], F.col("p"), ["id"], parts=16).add(n=("sum", F.lit(1))).result().toPandas().sort_values(["p", "id"])
    assert got["n"].tolist() == list(range(1, len(got) + 1))
    assert Scan(table.where("false"), ["k"], F.col("p")).add(n=("sum", F.lit(1))).result().count() == 0


def test_streak_drawdown_share_and_unsorted_rows_of_a_hot_key(table):
    frame = table.toPandas().fillna({"k": "-"}).sort_values(["p", "id"])
    runs = {r["k"] or "-": r["longest_streak"] for r in longest_streak(table, ["k"], ["p", "id"], F.col("v") > 0).collect()}
    falls = drawdown(table, ["k"], ["p", "id"], "v").toPandas().fillna({"k": "-"})
    back = {r["k"] or "-": r["out_of_order"] for r in unsorted_rows(table, ["k"], ["p", "id"], "v").collect()}
    for k, part in frame.groupby("k"):
        best = now = 0
        for x in part["v"]:
            now = now + 1 if x > 0 else 0
            best = max(best, now)
        assert runs[k] == best
        curve = part["v"].cumsum().ffill()
        want = (curve.cummax() - curve).dropna()
        have = falls[falls["k"] == k].sort_values(["p", "id"])["drawdown"].dropna()
        assert np.allclose(have.to_numpy()[-len(want):], want.to_numpy())
        assert back[k] == int((part["v"].shift(1) > part["v"]).sum())
    items = table.where("v > 0").select(F.col("id").cast("string").alias("name"), "v")
    shares = cumulative_share(items, "v", "name").toPandas().sort_values(["v", "name"], ascending=[False, True])
    assert np.allclose(shares["cumulative_share"], shares["v"].cumsum() / shares["v"].sum())


def test_unknown_operations_and_orders_are_refused(table):
    with pytest.raises(ValueError, match="unknown operation"):
        Scan(table, ["k"], F.col("p")).add(x=("median", F.col("v")))
    with pytest.raises(ValueError, match="ranges need"):
        as_number(table, "k")
