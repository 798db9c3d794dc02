"""The model protocol on planted labels: rounds by patience, folds side by side, runs that go on where they stopped."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from barlab.operators import classify as CL
from barlab.session import materialise, new_path

FEATURES = ["x", "noise", "flat", "gone"]


@pytest.fixture(scope="module")
def planted(spark):
    """Two features, one of them decides the label in nine of ten rows; one is constant, one always null."""
    rng = random.Random(1)
    rows = []
    for i in range(240):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
        for s in range(4):
            x = rng.random()
            y = float((x > 0.6) != (rng.random() < 0.1)) if rng.random() < 0.97 else None
            rows.append((f"S{s}", day, y, x if rng.random() < 0.95 else None, rng.random(), 1.0, None, x / 10, 0.1))
    schema = "symbol string, date date, y double, x double, noise double, flat double, gone double, abs_ret_1d double, atr_pct double"
    return materialise(spark.createDataFrame(rows, schema).repartition(2), "planted")


@pytest.fixture(scope="module")
def folds(spark, planted):
    """Two blocks; a third whose training rows are all of one class is left out."""
    dates = planted.select("date").distinct()
    day = F.datediff("date", F.lit("2020-01-01"))
    role = F.when(day < 120 + 40 * F.col("fold"), "train").when((day >= 130 + 40 * F.col("fold")) & (day < 170 + 40 * F.col("fold")), "test")
    both = dates.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("role", role).where("role IS NOT NULL")
    odd = planted.groupBy("date").agg(F.max("y").alias("m"), F.min("y").alias("n")).where("m = 0 OR n = 1")
    one = odd.where("m = 0").select("date").withColumns({"fold": F.lit(2), "role": F.lit("train")})
    late = dates.where(day > 235).withColumns({"fold": F.lit(2), "role": F.lit("test")})
    return materialise(both.unionByName(one).unionByName(late).select("fold", "role", "date"), "planted-folds")


def test_patience_decides():
    assert CL.best_round([0.5, 0.4, 0.45, 0.41], 2) == 2
    assert CL.best_round([0.5, 0.4, 0.45], 2) is None           # one round later is too early to tell
    assert CL.best_round([0.5, 0.4, 0.4, 0.4], 2) == 2          # the fewest rounds on ties
    assert CL.best_round([0.5, 0.4, 0.3, 0.2], 1) is None


def test_rounds_are_those_of_the_lowest_loss(planted, folds):
    train, test = CL.fold_rows(planted, folds, 1)
    fitted = CL.fit_boosted(train, FEATURES, {"maxDepth": 2}, patience=2, max_rounds=12)
    best = min(range(len(fitted.losses)), key=fitted.losses.__getitem__) + 1
    assert fitted.model.getNumTrees == best and fitted.features == ["x", "noise"]
    assert len(fitted.losses) == 12 or len(fitted.losses) >= best + 2
    scored = fitted.score(test)
    right = scored.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.8 and scored.count() == test.count()
    gains = {r.feature: r.importance for r in CL.gain_importance(fitted, FEATURES, planted.sparkSession).collect()}
    assert gains["flat"] == gains["gone"] == 0 and gains["x"] > 0.8 and abs(sum(gains.values()) - 1) < 1e-9


def test_most_rounds_end_the_search(planted, folds):
    train, _test = CL.fold_rows(planted, folds, 0)
    fitted = CL.fit_boosted(train, ["x"], {"maxDepth": 1, "stepSize": 0.01}, patience=2, max_rounds=3)
    assert len(fitted.losses) == 3 and fitted.model.getNumTrees <= 3


def test_all_strategies_share_the_blocks(planted, folds):
    scores = CL.walk_forward(planted, folds, FEATURES, {"maxDepth": 2}, patience=1, max_rounds=3).toPandas()
    assert set(scores.strategy) == {"prior", "vol_cluster", "logit", "boosted"} and set(scores.fold) == {0, 1}
    blocks = {k: set(zip(g.fold, g.symbol, g.date)) for k, g in scores.groupby("strategy")}
    assert len(set(map(frozenset, blocks.values()))) == 1 and len(scores) == 4 * len(blocks["prior"])
    train = planted.where("y IS NOT NULL").join(folds.where("fold = 1 AND role = 'train'"), "date").agg(F.avg("y")).first()[0]
    prior = scores[(scores.strategy == "prior") & (scores.fold == 1)].p
    assert abs(prior - train).max() < 1e-12


def test_a_run_goes_on_where_it_stopped(planted, folds, monkeypatch):
    root = new_path(planted.sparkSession, "resumed")
    how = {"patience": 1, "max_rounds": 2, "workers": 1}
    real, calls = CL.boosted_trees, []

    def dies_second(train, test, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        return real(train, test, *a, **k)

    monkeypatch.setattr(CL, "boosted_trees", dies_second)
    with pytest.raises(OSError, match="lost"):
        CL.boosted_folds(planted, folds, ["x"], {"maxDepth": 1}, root, **how)
    assert os.path.exists(f"{root}/scores/fold=0/_SUCCESS") and not os.path.exists(f"{root}/scores/fold=1")
    scores, gains = CL.boosted_folds(planted, folds, ["x"], {"maxDepth": 1}, root, **how)
    assert len(calls) == 3 and {r.fold for r in scores.select("fold").distinct().collect()} == {0, 1} and gains.count() == 2


def test_the_first_failure_stops_the_others(spark):
    started = []

    def slow():
        started.append(1)
        spark.range(1).count()

    def fails():
        raise ValueError("planted")

    with pytest.raises(ValueError, match="planted"):
        CL.run_side_by_side(spark, [fails, *[slow] * 50], workers=1)
    assert len(started) < 50


def test_search_ranks_every_trial(planted, folds):
    trials = CL.random_params(30)
    assert all(3 <= t["maxDepth"] <= 7 and 0.01 <= t["stepSize"] <= 0.2 and 50 <= t["minInstancesPerNode"] <= 1000 for t in trials)
    assert trials == CL.random_params(30)
    rows = CL.random_search(planted, folds, FEATURES, trials[:2], patience=1, max_rounds=2).collect()
    assert {r.trial for r in rows} == {0, 1} and rows[0].mean_pr_auc >= rows[1].mean_pr_auc
