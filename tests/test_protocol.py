"""Splits, selection fallbacks and score metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import scores as SC
from barlab.operators import splits as SP
from barlab.operators import strength as ST
from barlab.operators.anomalies import Forest, flag_anomalies, grow_forest, mean_path, permutation_importance, score_rows
from barlab.operators.clusters import silhouette


def panel(spark, dates, symbols=3):
    d = spark.range(dates).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"))
    return d.select("date", F.explode(F.array(*[F.lit(f"S{i}") for i in range(symbols)])).alias("symbol"))


def test_folds_by_eye(spark):
    rows = SP.purged_walk_forward(panel(spark, 400), n_folds=3).collect()
    start = min(r["date"] for r in SP.date_positions(panel(spark, 400)).select("date").collect())
    at = {}
    for r in rows:
        at.setdefault((r["fold"], r["role"]), []).append((r["date"] - start).days)
    spans = {k: (min(v), max(v)) for k, v in at.items()}
    # first test position is max(250 + 11, 140) = 261, blocks of 46, the last one takes the remainder
    assert spans[(0, "test")] == (261, 306) and spans[(1, "test")] == (307, 352) and spans[(2, "test")] == (353, 399)
    assert spans[(0, "train")] == (0, 249) and spans[(2, "train")] == (0, 341)


def test_too_few_dates_raise(spark):
    with pytest.raises(Exception, match="too few"):
        SP.purged_walk_forward(panel(spark, 200)).collect()


@pytest.mark.parametrize("dates, folds, horizon, embargo, expanding", [(500, 4, 1, 10, True), (420, 3, 5, 3, False), (700, 6, 2, 0, True)])
def test_random_calendars_never_leak(spark, dates, folds, horizon, embargo, expanding):
    p = panel(spark, dates)
    made = SP.purged_walk_forward(p, folds, horizon, embargo, expanding, 200)
    report = SP.assert_no_leakage(made, p, horizon).collect()
    assert len(report) == folds and all(r["clean"] for r in report)


def test_a_leak_raises(spark):
    p = panel(spark, 30)
    leak = p.select("date").distinct().withColumn("fold", F.lit(0)).withColumn("role", F.when(F.dayofmonth("date") <= 15, "train").otherwise("test"))
    with pytest.raises(Exception, match="leakage in fold 0"):
        SP.assert_no_leakage(leak.select("fold", "role", "date"), p).collect()


def candidates(spark, rows):
    schema = "date string, checkpoint string, symbol string, r_rank int, RS_sector double, RS_market double, filterA_ok boolean, hit_2pct boolean"
    return spark.createDataFrame([("d", "09:00", f"X{i}", i + 1, *r, True) for i, r in enumerate(rows)], schema)


def chosen(frame, method, n=10):
    rows = ST.select_by_method(frame, n).where(F.col("method") == method).orderBy("pos").collect()
    return [r["symbol"] for r in rows]


def test_selection_fallbacks(spark):
    none = candidates(spark, [(None, None, None)] * 2)
    two = candidates(spark, [(0.1, 0.2, False), (-0.1, 0.2, True), (0.3, 0.1, None)])
    for method in ("B0_R_alone", "B1_R_filterA", "S1_sector_filter", "S3_both_filter", "S4_filterA_marketRS"):
        assert chosen(none, method) == ["X0", "X1"]
    assert chosen(two, "B1_R_filterA") == ["X1"]
    assert chosen(two, "S1_sector_filter") == ["X0", "X2"]
    assert chosen(two, "S1_sector_rank") == ["X2", "X0", "X1"]
    # both positive for two rows only, so the weaker rule takes over
    assert chosen(two, "S3_both_filter") == ["X0", "X1", "X2"]
    assert chosen(two, "S4_filterA_sectorRS") == ["X1"]


def test_rank_methods_cannot_change_a_full_board(spark):
    rng = np.random.default_rng(0)
    twelve = candidates(spark, [(float(a), float(b), bool(a > 0)) for a, b in rng.normal(size=(10, 2))])
    assert set(chosen(twelve, "S2_market_rank")) == set(chosen(twelve, "B0_R_alone"))


def test_metrics_against_counting(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400).astype(float)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y double, p double")
    ap, seen_pos, seen = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        here = p == s
        seen_pos, seen = seen_pos + y[here].sum(), seen + here.sum()
        ap += y[here].sum() / y.sum() * seen_pos / seen
    assert SC.pr_auc(df, []).first()[0] == pytest.approx(ap)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert SC.roc_auc(df, []).first()[0] == pytest.approx(np.mean(pairs))
    order = np.lexsort((np.arange(400), -p))
    assert SC.precision_at_k(df, [], F.col("id")).first()["prec_10"] == pytest.approx(y[order[:40]].mean())


def test_constant_scores_are_scored(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("double").alias("y"), F.lit(0.25).alias("p"))
    assert SC.pr_auc(df, []).first()[0] == pytest.approx(0.25)
    assert SC.roc_auc(df, []).first()[0] == pytest.approx(0.5)
    assert SC.precision_at_k(df, [], F.col("id")).first()["prec_1"] == pytest.approx(0.3)


def test_forest_finds_planted_outliers(spark):
    base = spark.range(4000).select("id", *[(F.randn(i) + F.when(F.col("id") < 8, 9.0).otherwise(0.0)).alias(f"f{i}") for i in range(4)])
    rows = base.cache()
    cols = [f"f{i}" for i in range(4)]
    forest = Forest(grow_forest(rows, cols, ["id"], n_trees=40), cols)
    assert len(forest.trees) == 40
    out = flag_anomalies(score_rows(rows, forest), 0.005).where("is_anomaly").select("id").collect()
    assert len(out) == 20 and {r["id"] for r in out} >= set(range(8))


def test_forest_of_a_small_table(spark):
    rows = spark.range(30).select("id", F.col("id").cast("double").alias("f0"), (F.col("id") % 7).cast("double").alias("f1")).cache()
    grown = grow_forest(rows, ["f0", "f1"], ["id"], n_trees=20)
    forest = Forest(grown, ["f0", "f1"])
    sizes = [r["rows"] for r in grown.collect()]
    assert max(sizes) <= 30 and forest.norm == pytest.approx(float(np.mean([mean_path(n) for n in sizes])))
    # every row steps down every tree by hand
    x = np.array([[3.0, 3.0], [29.0, 1.0]])
    for point, got in zip(x, forest.raw_score(x)):
        depths = []
        for t in grown.orderBy("tree").collect():
            node = 0
            while t["feature"][node] >= 0:
                node = t["left"][node] if point[t["feature"][node]] <= t["threshold"][node] else t["right"][node]
            depths.append(t["depth"][node])
        assert got == pytest.approx(-(2.0 ** (-np.mean(depths) / forest.norm)))


def test_importance_of_a_constant_column_is_zero(spark):
    rows = spark.range(3000).select("id", F.randn(1).alias("f0"), F.lit(1.0).alias("f1")).cache()
    forest = Forest(grow_forest(rows, ["f0", "f1"], ["id"], n_trees=20), ["f0", "f1"])
    out = permutation_importance(flag_anomalies(score_rows(rows, forest)), forest, ["id"]).collect()
    got = {(r["scope"], r["feature"]): r["importance"] for r in out}
    assert got == {(s, f): pytest.approx(v) for s in ("global", "flagged") for f, v in (("f0", 1.0), ("f1", 0.0))}
    # 15 flagged rows are too few: their view is that of all rows, with more repeats
    shift = {r["scope"]: r["shift"] for r in out if r["feature"] == "f0"}
    assert shift["flagged"] == pytest.approx(shift["global"], rel=0.2)


def test_silhouette_blocks_agree_with_a_loop(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(4, 1, (50, 2))])
    c = [0] * 60 + [1] * 49 + [2]
    df = spark.createDataFrame([(i, int(k), float(a), float(b)) for i, (k, (a, b)) in enumerate(zip(c, x))], "id long, c int, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    c = np.array(c)
    s = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        inside, outside = d[i, own].mean(), min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((outside - inside) / max(inside, outside))
    assert silhouette(df, "id", "c", ["a", "b"]).first()["silhouette"] == pytest.approx(np.mean(s))
