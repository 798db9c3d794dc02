"""Unsupervised outliers: a random-split forest grown per tree, scored over all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions.ordering import exact_percentiles, with_row_number, with_running
from barlab.functions.windows import nonzero
from barlab.session import materialise

SAMPLE_ROWS = 256
TREE = "tree int, rows int, feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def mean_path(n):
    """Expected depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    feature, threshold, left, right, depth = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, None)]
    while todo:
        rows, level, parent = todo.pop()
        me = len(feature)
        if parent is not None:
            node, side = parent
            (left if side == 0 else right)[node] = me
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or len(open_features) == 0:
            values = (-1, 0.0, float(level + mean_path(len(rows))))
        else:
            f = int(rng.choice(open_features))
            values = (f, float(rng.uniform(lo[f], hi[f])), 0.0)
        feature.append(values[0])
        threshold.append(values[1])
        depth.append(values[2])
        left.append(-1)
        right.append(-1)
        if values[0] >= 0:
            below = x[rows, values[0]] <= values[1]
            todo.append((rows[below], level + 1, (me, 0)))
            todo.append((rows[~below], level + 1, (me, 1)))
    return feature, threshold, left, right, depth


def grow_forest(df: DataFrame, columns: Sequence[str], key: Sequence[str], n_trees: int = 200, seed: int = 42,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per tree.

    Rows are dealt to trees by hash, about a third more than a tree needs, so
    a tree's task never holds more than a few hundred rows however large the
    table is. A small table deals each row to several trees.
    """
    n = df.agg(F.count(F.lit(1))).scalar()
    share = F.lit(n_trees * sample_rows * 1.35) / nonzero(n)
    unit = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    copies = (F.floor(share) + (unit < share - F.floor(share)).cast("long")).cast("int")
    # a table smaller than one tree's sample is used whole by every tree
    copies = F.least(copies, F.lit(n_trees))
    x = F.array(*[F.col(c).cast("double") for c in columns])
    dealt = df.select(*key, x.alias("x"), copies.alias("_c")).where("_c > 0")
    start = F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(n_trees))
    dealt = dealt.withColumn("_start", start).select("*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_j"))
    stride = max(1, n_trees // 7) | 1
    while math.gcd(stride, n_trees) != 1:
        stride += 1
    tree = F.pmod(F.col("_start") + F.col("_j") * stride, F.lit(n_trees)).cast("int")
    dealt = dealt.select(tree.alias("tree"), "x", F.xxhash64(*key, "_j", F.lit(seed + 2)).alias("h"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("h").head(sample_rows)
        sample = np.stack(rows["x"])
        number = int(rows["tree"].iloc[0])
        grown = _grow(sample, np.random.default_rng([seed, number]), math.ceil(math.log2(max(2, len(sample)))))
        return pd.DataFrame({"tree": [number], "rows": [len(sample)], **{n: [v] for n, v in zip(("feature", "threshold", "left", "right", "depth"), grown)}})

    return dealt.groupBy("tree").applyInPandas(fit, TREE)


class Forest:
    """A grown forest; its size is set by the number of trees, not by the data.

    All trees lie in one set of arrays. A leaf is its own child, so every row
    steps down all trees at once, as often as the deepest tree has levels.
    """

    BLOCK = 1024

    def __init__(self, trees: DataFrame, columns: Sequence[str]):
        self.columns = list(columns)
        grown = trees.orderBy("tree").collect()
        # trees of a small table saw fewer rows than the sample size
        self.norm = float(np.mean([mean_path(r["rows"]) for r in grown])) or 1.0
        sizes = [len(r["feature"]) for r in grown]
        # where each tree starts
        self.trees = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32)
        feature, left, right = (np.concatenate([np.asarray(r[c]) for r in grown]) for c in ("feature", "left", "right"))
        leaf, own, base = feature < 0, np.arange(len(feature)), np.repeat(self.trees, sizes)
        self.feature = np.where(leaf, 0, feature).astype(np.int32)
        self.left, self.right = (np.where(leaf, own, base + c).astype(np.int32) for c in (left, right))
        self.threshold, self.depth = (np.concatenate([np.asarray(r[c], dtype=float) for r in grown]) for c in ("threshold", "depth"))
        self.leaf = leaf

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly degree: lower is more unusual."""
        out = np.zeros(len(x))
        for start in range(0, len(x), self.BLOCK):
            part = x[start:start + self.BLOCK]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.trees, (len(part), len(self.trees)))
            while not self.leaf[node].all():
                below = part[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            out[start:start + self.BLOCK] = self.depth[node].mean(axis=1)
        return -np.power(2.0, -out / self.norm)


def score_rows(df: DataFrame, forest: Forest) -> DataFrame:
    """Score every row in its own partition, batch by batch."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    columns = forest.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield batch.assign(raw_score=model.raw_score(batch[columns].to_numpy(dtype=float)))

    schema = T.StructType([*df.schema.fields, T.StructField("raw_score", T.DoubleType())])
    return df.mapInPandas(run, schema)


def flag_anomalies(scored: DataFrame, contamination: float = 0.005) -> DataFrame:
    """Score relative to the contamination quantile; below zero is an anomaly."""
    cut = exact_percentiles(scored, [], "raw_score", {"cut": contamination}).scalar()
    out = scored.withColumn("anomaly_score", F.col("raw_score") - cut)
    return out.withColumn("is_anomaly", F.col("anomaly_score") < 0).drop("raw_score")


def permutation_importance(flagged: DataFrame, forest: Forest, key: Sequence[str], repeats: int = 3, flagged_repeats: int = 5,
                           seed: int = 42, min_flagged: int = 100) -> DataFrame:
    """Mean score shift when one column is shuffled, over all rows and over the flagged ones.

    Rows are numbered in hash order, and each repeat gives every row another
    row's values by a shift of that order: one join with equal keys, and every
    row is scored. With fewer than ``min_flagged`` flagged rows their view is
    that of all rows.
    """
    columns = forest.columns
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    n_flagged = flagged.agg(F.count_if("is_anomaly")).scalar()
    rows = flagged.select(x, "is_anomaly", F.xxhash64(*key, F.lit(seed)).alias("h"), F.xxhash64(*key, F.lit(seed + 1)).alias("tie"))

    def scope(view: DataFrame, name: str, times: int) -> DataFrame:
        numbered = materialise(with_row_number(view, [], F.col("h"), F.col("tie"), "n").select("n", "x"), "numbered")
        total = numbered.count()
        # shifts of no row onto itself, as far as there are rows
        shifts = [1 + (seed + 7919 * r) % max(total - 1, 1) for r in range(times)]
        taken = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(s).alias("by")) for r, s in enumerate(shifts)])).alias("t")
        asking = numbered.select("n", "x", taken).select("x", "t.repeat", (F.pmod(F.col("n") - 1 + F.col("t.by"), F.lit(max(total, 1))) + 1).alias("n"))
        return asking.join(numbered.select("n", F.col("x").alias("other")), "n").select(F.lit(name).alias("scope"), "repeat", "x", "other")

    focus = rows.where(F.col("is_anomaly") | (n_flagged < min_flagged))
    pairs = scope(rows, "global", repeats).unionByName(scope(focus, "flagged", flagged_repeats))
    shared = flagged.sparkSession.sparkContext.broadcast(forest)

    def shift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            values, other = np.stack(batch["x"]), np.stack(batch["other"])
            base, parts = model.raw_score(values), []
            for j, name in enumerate(columns):
                moved = values.copy()
                moved[:, j] = other[:, j]
                by = batch[["scope"]].assign(moved=np.abs(model.raw_score(moved) - base)).groupby("scope")["moved"]
                parts.append(by.agg(["sum", "count"]).reset_index().assign(feature=name))
            yield pd.concat(parts)[["scope", "feature", "sum", "count"]]

    shifts = pairs.mapInPandas(shift, "scope string, feature string, sum double, count long")
    means = shifts.groupBy("scope", "feature").agg((F.sum("sum") / F.sum("count")).alias("shift"))
    total = F.sum("shift").over(Window.partitionBy("scope"))
    return means.withColumn("importance", F.coalesce(F.col("shift") / nonzero(total), F.lit(0.0)))


def importance_table(importances: DataFrame, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Shares with their running share, largest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), "feature")
    return importances.withColumns({
        "rank": F.row_number().over(w), "cumulative_share": F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })


def known_event_recall(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Registered events with their label and the percent of all scores strictly below theirs."""
    counted = labels.where(F.col("anomaly_score").isNotNull()).groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("n"))
    placed = with_running(counted, [], F.col("anomaly_score"), {"upto": F.col("n")})
    total = labels.agg(F.count("anomaly_score")).scalar()
    below = placed.select("anomaly_score", ((F.col("upto") - F.col("n")) / total * 100).alias("score_percentile"))
    hits = events.select("symbol", F.col("ex_date").alias("date")).join(labels.select("symbol", "date", "anomaly_score", "is_anomaly"), ["symbol", "date"], "left")
    out = hits.join(below, "anomaly_score", "left")
    return out.withColumn("detected", F.coalesce("is_anomaly", F.lit(False)))


def recall(known: DataFrame) -> DataFrame:
    return known.agg(F.count(F.lit(1)).alias("events"), F.count_if("detected").alias("found"), F.avg(F.col("detected").cast("double")).alias("recall"))


def top_anomalies(labels: DataFrame, n: int) -> DataFrame:
    return labels.orderBy("anomaly_score", "symbol", "date").limit(n)


def anomalies_per_symbol(labels: DataFrame, n: int) -> DataFrame:
    return labels.where("is_anomaly").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_anomalies")).orderBy(F.desc("n_anomalies"), "symbol").limit(n)


def anomalies_per_month(labels: DataFrame) -> DataFrame:
    return labels.where("is_anomaly").groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n_anomalies"))


def scorecard(stats: DataFrame) -> DataFrame:
    """Named acceptance checks from one row of statistics."""
    # Names and limits of the checks.
    checks = (
        ("Known-event recall", "100%", "recall", F.col("recall") >= 1.0),
        ("Anomaly budget", "0.1%-2%", "anomaly_rate", F.col("anomaly_rate").between(0.001, 0.02)),
        ("Silhouette score", "> 0.20", "silhouette", F.col("silhouette") > 0.20),
        ("Distinct nameable regimes", "all", "distinct_names", F.col("distinct_names") == F.col("clusters")),
        ("Cluster stability (ARI)", "> 0.80", "ari", F.col("ari") > 0.80),
        ("Gap among leading features", "top 3", "gap_rank", F.col("gap_rank") <= 3),
    )
    have = set(stats.columns)
    rows = [
        F.struct(F.lit(name).alias("check"), F.lit(need).alias("required"), F.col(c).cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("passed"))
        for name, need, c, ok in checks if c in have
    ]
    return stats.select(F.inline(F.array(*rows)))
