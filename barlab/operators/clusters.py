"""Market-day regimes: scaling, clustering, silhouettes, profiles, names and stability."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.windows import nonzero
from barlab.operators.kmeans import MAX_ITER, STARTS, cheapest, fit_all, points
from barlab.session import materialise

BLOCK_ROWS = 4096


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes zero."""
    moments = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("m"))
    work = df.withColumn("_m", moments.scalar())
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.col(f"_m.m_{c}")) / F.coalesce(nonzero(F.col(f"_m.s_{c}")), F.lit(1.0)) for c in columns
    }
    return work.withColumns(scaled).drop("_m")


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def kmeans_regimes(df: DataFrame, key: str, columns: Sequence[str], k_range: tuple[int, int] = (3, 8),
                   seeds: Sequence[int] = tuple(range(STARTS)), max_iter: int = MAX_ITER) -> tuple[DataFrame, DataFrame]:
    """Fit every k from every seed in common passes, keep the k with the best silhouette: (score table, labelled days)."""
    low, high = k_range
    if low < 2 or high < low:
        raise ValueError("k_range must be at least 2 and rising")
    zs = [f"{c}_z" for c in columns]
    days = materialise(standardize(df, columns), "regimes")
    fits = fit_all(materialise(points(days, key, zs), "points"), [(k, s) for k in range(low, high + 1) for s in seeds], max_iter)
    tried = []
    for k in range(low, high + 1):
        fit = cheapest(fits[(k - low) * len(seeds) : (k - low + 1) * len(seeds)])
        exact = silhouette(days.withColumn("cluster_id", fit.label(zs)), key, "cluster_id", zs).first()["silhouette"]
        tried.append((k, float(exact), fit.cost, fit))
    best = max(tried, key=lambda t: (t[1], -t[0]))
    table = df.sparkSession.createDataFrame(
        [(k, s, c, k == best[0]) for k, s, c, _ in tried], "k int, silhouette double, cost double, chosen boolean"
    )
    return table, days.withColumn("cluster_id", best[3].label(zs))


def silhouette(df: DataFrame, key: str, cluster: str, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean Euclidean silhouette, exact, for any number of points.

    Points are cut into blocks of about ``block_rows``. A task takes two blocks
    and hands on, for each point of the first, its summed distance to the second
    one's points of every cluster; these sums are added up over blocks. No task
    holds more than two blocks, and no pair of points leaves a task. The work
    itself is all pairs: :func:`silhouette_squared` is linear.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(cluster).cast("int").alias("c"), x.alias("x"), F.xxhash64(key).alias("h"), F.monotonically_increasing_id().alias("p"))
    rows = materialise(rows, "silhouette")
    sizes = {r.c: r.n for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster
    groups = np.array(sorted(sizes), np.int64)
    blocks = max(1, math.ceil(sum(sizes.values()) / block_rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = rows.withColumn("own", F.pmod(F.xxhash64("h", "p"), F.lit(blocks)).cast("int"))
    left = placed.select("p", "c", "x", F.col("own").alias("b"), every.alias("other"))
    right = placed.select(F.col("c").alias("to_c"), F.col("x").alias("to_x"), F.col("own").alias("to_other"), every.alias("to_b"))

    def sums(block: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if block.empty or others.empty:
            return pd.DataFrame({"p": pd.Series(dtype="int64"), "c": pd.Series(dtype="int32"), "s": pd.Series(dtype="object")})
        x, y = np.stack(block["x"]), np.stack(others["to_x"])
        member = (others["to_c"].to_numpy()[:, None] == groups[None, :]).astype(float)
        out = np.empty((len(x), len(groups)))
        for start in range(0, len(x), 256):
            part = x[start:start + 256]
            out[start:start + 256] = np.sqrt(((part[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)) @ member
        return pd.DataFrame({"p": block["p"], "c": block["c"], "s": list(out)})

    pairs = left.groupBy("b", "other").cogroup(right.groupBy("to_b", "to_other")).applyInPandas(sums, "p long, c int, s array<double>")
    total = pairs.groupBy("p", "c").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(groups))])
    inside, size, apart = F.lit(None).cast("double"), F.lit(0), []
    for i, g in enumerate(groups.tolist()):
        mine = F.col("c") == g
        inside = F.when(mine, F.col(f"s{i}") / max(sizes[g] - 1, 1)).otherwise(inside)
        size = F.when(mine, sizes[g]).otherwise(size)
        apart.append(F.when(~mine, F.col(f"s{i}") / sizes[g]))
    outside = F.array_min(F.array(*apart)) if len(groups) else F.lit(None).cast("double")
    value = F.when(size > 1, (outside - inside) / nonzero(F.greatest(inside, outside))).otherwise(0.0)
    return total.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_squared(df: DataFrame, cluster: str, columns: Sequence[str]) -> float | None:
    """Mean silhouette on squared distances from cluster moments: linear in rows, for tables of any size.

    Without a second cluster there is none, as in :func:`silhouette`; a single point has 0.
    """
    sizes = [r.n for r in df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).limit(2).collect()]
    if len(sizes) < 2:
        return 0.0 if sizes == [1] else None
    rows = with_vector(df, columns).withColumn("_c", F.col(cluster).cast("int"))
    return ClusteringEvaluator(featuresCol="features", predictionCol="_c", distanceMeasure="squaredEuclidean").evaluate(rows)


def cluster_profiles(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, size and share per cluster in original units."""
    out = df.groupBy(cluster).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
        F.count(F.lit(1)).alias("n_days"),
    )
    return out.withColumn("pct_days", F.col("n_days") / F.sum("n_days").over(Window.partitionBy(F.lit(0))))


def centroids(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f"{c}_z").alias(c) for c in columns])


def every_regime(z: DataFrame, cluster: str, regimes: Sequence[int]) -> DataFrame:
    """``z`` with a row for each regime of a rule, those without a day too; their features are null, so they stand out by nothing."""
    spark = z.sparkSession
    ruled = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in regimes])).alias(cluster))
    return ruled.join(z, cluster, "left")


# What each slot looks at and the words it may say.
SLOTS = (
    (("vix_level", "vix_change_pct"), "high_vol", "low_vol"),
    (("session_range_pct", "dvr_ratio"), "wide_range", "narrow_range"),
    (("body_pct",), "trending", "choppy"),
)


def name_clusters(z: DataFrame, cluster: str, threshold: float = 0.3) -> DataFrame:
    """Readable names from standardised centroids, made unique by gap sign and then by letter.

    ``z`` has one row per cluster.
    """
    words = []
    for features, high, low in SLOTS:
        lead = F.col(features[0])
        for f in features[1:]:
            lead = F.when(F.abs(F.col(f)) > F.abs(lead), F.col(f)).otherwise(lead)
        words.append(F.when(F.abs(lead) >= threshold, F.when(lead > 0, high).otherwise(low)))
    said = F.concat_ws("_", *words)
    named = z.withColumn("_name", F.when(said == "", "baseline_regime").otherwise(said))
    twice = F.count(F.lit(1)).over(Window.partitionBy("_name")) > 1
    gap = F.when(F.col("gap_pct") > 0, "gap_up").otherwise("gap_down")
    named = named.withColumn("_name", F.when(twice, F.concat_ws("_", "_name", gap)).otherwise(F.col("_name")))
    again = Window.partitionBy("_name")
    letter = F.char(F.lit(96) + F.row_number().over(again.orderBy(cluster)))
    final = F.when(F.count(F.lit(1)).over(again) > 1, F.concat_ws("_", "_name", letter)).otherwise(F.col("_name"))
    return named.select(cluster, final.alias("cluster_name"))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index from the contingency counts."""
    keys = list(keys)

    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    cells = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(*keys, a).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("_ra"))
    cols = cells.groupBy(*keys, b).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("_rb"))
    both = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("_rc"), F.sum("n").alias("n"))
    if keys:
        out = both.join(rows, keys).join(cols, keys)
    else:
        out = both.withColumn("_ra", rows.scalar()).withColumn("_rb", cols.scalar())
    chance = F.col("_ra") * F.col("_rb") / pairs(F.col("n"))
    top, bottom = F.col("_rc") - chance, (F.col("_ra") + F.col("_rb")) / 2 - chance
    return out.select(*keys, F.when(bottom == 0, 1.0).otherwise(top / nonzero(bottom)).alias("ari"))


def stability(df: DataFrame, key: str, columns: Sequence[str], k: int, seeds: Sequence[int] = (0, 1, 2, 3, 4), max_iter: int = MAX_ITER) -> DataFrame:
    """Mean pairwise adjusted Rand index over fits from different seeds, all fitted in common passes."""
    rows = materialise(df.select(key, *columns), "stability")
    fits = fit_all(points(rows, key, columns), [(k, s) for s in seeds], max_iter)
    labelled = rows.select(key, *[f.label(columns).alias(f"fit_{f.seed}") for f in fits])
    duo = [(i, j) for n, i in enumerate(seeds) for j in seeds[n + 1:]]
    stacked = labelled.select(F.inline(F.array(*[
        F.struct(F.lit(f"{i}-{j}").alias("duo"), F.col(f"fit_{i}").alias("a"), F.col(f"fit_{j}").alias("b")) for i, j in duo
    ])))
    return adjusted_rand(stacked, "a", "b", ["duo"]).agg(F.avg("ari").alias("stability_ari"), F.count(F.lit(1)).alias("n_pairs"))
