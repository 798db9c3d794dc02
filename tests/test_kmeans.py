"""Many k-means starts in common passes, and the silhouette by block pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import kmeans
from barlab.operators.clusters import silhouette, silhouette_squared, stability


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (n, 3)) for m, n in ((0, 300), (8, 120), (-9, 80))])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(9999, None, 1.0, 1.0), (9998, float("nan"), 0.0, 0.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(6), x


def lloyd(x, centers, steps=500):
    for _ in range(steps):
        own = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[own == j].mean(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        if np.allclose(after, centers):
            break
        centers = after
    return ((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum()


def test_every_start_settles_where_a_plain_loop_does(cloud):
    df, x = cloud
    rows = kmeans.points(df, "id", ["a", "b", "c"])
    first = kmeans.seeded(rows, [0, 1, 2, 3], 4)
    fits = kmeans.fit_all(rows, [(k, s) for k in (3, 4) for s in range(4)])
    assert [f.k for f in fits] == [3] * 4 + [4] * 4
    for fit in fits:
        assert fit.cost == pytest.approx(lloyd(x, first[fit.seed][: fit.k]), rel=2e-2)
        assert 1 <= fit.steps <= kmeans.MAX_ITER
    best = kmeans.cheapest(fits[:4])
    true = sum(((p - p.mean(0)) ** 2).sum() for p in (x[:300], x[300:420], x[420:]))
    assert best.cost == pytest.approx(true, rel=1e-6)
    labels = {r.id: r.label for r in df.where("id < 500").select("id", best.label(["a", "b", "c"]).alias("label")).collect()}
    assert len({labels[i] for i in range(300)}) == 1 and len(set(labels.values())) == 3


def test_draws_do_not_depend_on_partitions_and_are_points(cloud):
    df, x = cloud
    rows = kmeans.points(df, "id", ["a", "b", "c"])
    one, two = (kmeans.seeded(rows.repartition(n), [0, 7], 5) for n in (1, 9))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    assert all(any(np.array_equal(c, p) for p in x) for c in one[0]) and not np.array_equal(one[0], one[1])


def test_few_distinct_points(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "id long, a double")
    fits = kmeans.fit_all(kmeans.points(df, "id", ["a"]), [(4, 0)])
    assert fits[0].k == 2 and fits[0].cost == 0
    with pytest.raises(ValueError, match="no rows"):
        kmeans.fit_all(kmeans.points(df.where("false"), "id", ["a"]), [(2, 0)])


def test_stability_of_clear_groups_is_one(cloud):
    df, _ = cloud
    got = stability(df.where("id < 500"), "id", ["a", "b", "c"], 3, (0, 1, 2)).first()
    assert got.n_pairs == 3 and got.stability_ari > 0.5


@pytest.mark.parametrize("rows", [37, 4096])
def test_silhouette_does_not_depend_on_blocks(cloud, rows):
    df, x = cloud
    labelled = df.where("id < 500").withColumn("g", F.when(F.col("id") < 300, 0).when(F.col("id") < 499, 5).otherwise(9))
    c = np.array([0] * 300 + [5] * 199 + [9])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(500):
        own = (c == c[i]) & (np.arange(500) != i)
        inside = d[i, own].mean() if own.any() else 0
        outside = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((outside - inside) / max(inside, outside) if own.any() else 0.0)
    got = silhouette(labelled, "id", "g", ["a", "b", "c"], rows).first()
    assert got.n == 500 and got.silhouette == pytest.approx(np.mean(s))


def test_silhouettes_of_one_cluster_are_missing(cloud):
    df, _ = cloud
    one = df.where("id < 500").withColumn("g", F.lit(1))
    assert silhouette_squared(one, "g", ["a", "b", "c"]) is None
    assert silhouette(one, "id", "g", ["a", "b", "c"]).first().silhouette is None
    assert silhouette_squared(one.where("id = 3"), "g", ["a", "b", "c"]) == 0
    assert silhouette_squared(one.where("id < 0"), "g", ["a", "b", "c"]) is None
