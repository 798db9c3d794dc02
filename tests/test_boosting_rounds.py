"""Boosting grows few rounds that it does not keep, and the same trees however its rows were cut before."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array

from barlab.operators import classify as CL
from barlab.operators.clusters import with_vector
from barlab.session import materialise


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        for s in range(4):
            x = rng.random()
            rows.append((f"S{s}", dt.date(2021, 1, 1) + dt.timedelta(days=i), float((x > 0.6) != (rng.random() < 0.2)), x, rng.random()))
    return materialise(spark.createDataFrame(rows, "symbol string, date date, y double, x double, noise double").repartition(3), "rounds")


def test_no_round_is_grown_again(train, monkeypatch):
    grown = []

    class Counted(GBTClassifier):
        def fit(self, rows):
            grown.append(self.getMaxIter())
            return super().fit(rows)

    monkeypatch.setattr(CL, "GBTClassifier", Counted)
    fitted = CL.fit_boosted(train, ["x", "noise"], {"maxDepth": 2}, patience=2, max_rounds=24)
    best = int(np.argmin(fitted.losses)) + 1
    assert fitted.model.getNumTrees == best < len(fitted.losses)
    assert grown[0] == 6 and all(b == 2 * a for a, b in zip(grown, grown[1:])) and len(fitted.losses) in (3, grown[-1])


def test_a_cut_booster_is_the_shorter_fit(train):
    rows = materialise(with_vector(train, ["x", "noise"]).select("features", "y"), "cut")
    def grow(n):
        return GBTClassifier(labelCol="y", maxIter=n, maxDepth=2, subsamplingRate=0.8, seed=7).fit(rows)
    cut, short = CL.first_rounds(grow(6), 2), grow(2)
    assert cut.getNumTrees == 2 and cut.treeWeights == short.treeWeights
    p = [[r[0] for r in m.transform(rows).select(vector_to_array("probability")[1]).collect()] for m in (cut, short)]
    assert p[0] == p[1] and len(set(p[0])) > 2


def test_trees_do_not_depend_on_how_the_rows_were_cut(train):
    one, many = (CL.fit_boosted(train.repartition(n), ["x", "noise"], {"maxDepth": 2}, patience=1, max_rounds=4) for n in (1, 7))
    assert np.allclose(one.losses, many.losses, rtol=0, atol=1e-9) and one.model.getNumTrees == many.model.getNumTrees


def test_a_fit_without_a_split_has_no_gains(train):
    fitted = CL.fit_boosted(train, ["x", "noise"], {"minInstancesPerNode": 5000}, patience=1, max_rounds=2)
    gains = CL.gain_importance(fitted, ["x", "noise"], train.sparkSession).collect()
    assert [r.importance for r in gains] == [0.0, 0.0] and fitted.score(train).count() == train.count()
