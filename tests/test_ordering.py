"""Ranks, running totals and percentiles that never hold a group in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.ordering import _attach_group, exact_percentiles, with_ranges, with_row_number, with_running


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.lognormal(1, 1, n), 2))
    rows = [(str(g), float(v), i) for i, (g, v) in enumerate(zip(group, value))]
    return spark.createDataFrame(rows, "g string, v double, id long").repartition(8)


def test_percentiles_equal_the_exact_ones(skewed):
    probs = {"p05": 0.05, "p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}
    got = {r["g"]: r for r in exact_percentiles(skewed, ["g"], "v", probs).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(part["v"].quantile(p), abs=1e-12)


def test_overall_percentiles(skewed):
    got = exact_percentiles(skewed, [], "v", {"m": 0.5}).first()["m"]
    assert got == pytest.approx(skewed.toPandas()["v"].median())


def test_row_number_with_heavy_ties(skewed):
    got = with_row_number(skewed, ["g"], F.col("v"), F.col("id"), "rn").toPandas()
    for _, part in got.groupby("g"):
        want = part.sort_values(["v", "id"])
        assert want["rn"].tolist() == list(range(1, len(part) + 1))


def test_heavy_value_gets_a_range_of_its_own_and_is_cut_by_the_tie(skewed):
    first = with_ranges(skewed, [], F.col("v"))
    parts = first.where("v = 5.0").select("_part").distinct().collect()
    assert len(parts) == 1 and parts[0][0] % 2 == 1
    assert first.where(F.col("_part") == parts[0][0]).where("v <> 5.0").count() == 0


def test_running_total(skewed):
    counted = skewed.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = with_running(counted, ["g"], -F.col("v"), {"upto": F.col("n")}).toPandas()
    for _, part in got.groupby("g"):
        want = part.sort_values("v", ascending=False)
        assert want["upto"].tolist() == want["n"].cumsum().tolist()


def test_null_groups_survive(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 2.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in exact_percentiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "x": 2.0}


@pytest.mark.parametrize("accuracy", [100, 400, 5000])
def test_selection_with_coarse_sketches(spark, accuracy):
    """Brackets that leave out most rows still give the exact ranks."""
    rng = np.random.default_rng(accuracy)
    rows = [("hot", float(x)) for x in rng.lognormal(0, 2, 40_000)] + [("tied", float(x)) for x in rng.integers(0, 3, 9000)]
    rows += [("few", 1.5), ("few", 2.5), ("one", 7.0), ("none", None), (None, 3.0), ("infinite", float("inf")), ("infinite", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs, accuracy).collect()}
    frame = df.toPandas().dropna(subset=["v"])
    assert set(got) == {"hot", "tied", "few", "one", None, "infinite"}
    for g in ("hot", "tied", "few", "one"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(frame[frame["g"] == g]["v"].quantile(p), rel=1e-12)
    whole = exact_percentiles(df.where("not g <=> 'infinite'"), [], "v", probs, accuracy).first()
    for name, p in probs.items():
        assert whole[name] == pytest.approx(frame[frame["g"] != "infinite"]["v"].quantile(p), rel=1e-12)


def test_selection_orders_few_rows(spark):
    """Of 200,000 distinct values only those in the brackets are ordered."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    found = exact_percentiles(df, [], "v", {"m": 0.5, "p": 0.9}, 5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 200000") == 2
    assert found.first()["m"] == pytest.approx(df.toPandas()["v"].median())


@pytest.fixture()
def joins_by_shuffle(spark):
    """Plans that neither broadcast nor coalesce, so that partitions show how rows are dealt."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("few", [False, True])
def test_one_group_meets_its_sketch_in_many_tasks(spark, joins_by_shuffle, few):
    df = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    sketch = spark.createDataFrame([("hot", 1)], "g string, c int")
    sizes = [r["count"] for r in _attach_group(df, sketch, ["g"], few).groupBy(F.spark_partition_id().alias("p"), "c").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2000


def test_ranges_of_one_group_are_cut_in_many_tasks(spark, joins_by_shuffle):
    df = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"))
    ranged = with_ranges(df, ["g"], F.col("v"))
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2000


@pytest.mark.parametrize("few", [False, True])
def test_percentiles_of_few_groups(skewed, few):
    got = {r["g"]: r["m"] for r in exact_percentiles(skewed, ["g"], "v", {"m": 0.9}, few=few).collect()}
    for g, part in skewed.toPandas().groupby("g"):
        assert got[g] == pytest.approx(part["v"].quantile(0.9), abs=1e-12)
