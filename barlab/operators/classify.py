"""Baselines and boosted trees for the significant-move label, evaluated walk-forward."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.windows import nonzero
from barlab.operators.clusters import with_vector
from barlab.operators.scores import pr_auc
from barlab.operators.splits import chronological_holdout
from barlab.session import materialise, new_path

# What the linear baseline may see.
LOGIT_FEATURES = ("abs_ret_1d", "atr_pct", "range_pct", "vol_ratio_short_long", "volume_ratio_20d", "abs_ret_zscore_20d", "vix_level")
# Fixed values of the protocol: rounds without gain before boosting stops, most rounds, trials of a search, seed.
PATIENCE, MAX_ROUNDS, TRIALS, SEED = 100, 2000, 40, 42
# Fits side by side: the outer folds at once. Rows of a fit that one task holds.
WORKERS, ROWS_PER_TASK = 6, 8_192


def prior_score(train: DataFrame, test: DataFrame) -> DataFrame:
    """The training base rate for every test row."""
    return test.withColumn("p", F.coalesce(train.agg(F.avg("y")).scalar(), F.lit(0.5)))


def vol_cluster_score(df: DataFrame) -> DataFrame:
    """Today's move in range units, squashed into (0, 1); unknown counts as zero."""
    size = F.coalesce(F.col("abs_ret_1d") / nonzero(F.col("atr_pct")), F.lit(0.0))
    return df.withColumn("p", 1 - F.exp(-size / 2))


def with_balance(train: DataFrame, mode: str = "balanced") -> DataFrame:
    """Row weights: equal class totals, or positives scaled by the clipped class ratio."""
    n = train.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).alias("s")).scalar()
    work = train.withColumn("_s", n)
    rows, pos = F.col("_s.n"), F.col("_s.pos")
    if mode == "balanced":
        weight = F.when(F.col("y") == 1, rows / (2 * nonzero(pos))).otherwise(rows / (2 * nonzero(rows - pos)))
    else:
        scale = F.least(F.greatest((rows - pos) / nonzero(pos), F.lit(1.0)), F.lit(50.0))
        weight = F.when(F.col("y") == 1, F.coalesce(scale, F.lit(1.0))).otherwise(F.lit(1.0))
    return work.withColumn("weight", F.coalesce(weight, F.lit(1.0))).drop("_s")


def impute(train: DataFrame, features: Sequence[str]):
    """Medians of the training rows only."""
    return Imputer(strategy="median", inputCols=list(features), outputCols=[f"{f}_i" for f in features], relativeError=1e-4).fit(train)


def varying(train: DataFrame, features: Sequence[str]) -> list[str]:
    """The features with at least two different values in the training rows; the others cannot split or be filled."""
    row = train.agg(*[F.coalesce(F.min(f) < F.max(f), F.lit(False)).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def logit_baseline(train: DataFrame, test: DataFrame, features: Sequence[str] = LOGIT_FEATURES, c: float = 1.0) -> DataFrame:
    """Median fill, scaling and a balanced ridge logit.

    The penalty is divided by the number of rows because Spark minimises the
    mean loss; weights sum to the row count. Features that never vary in the
    training rows are left out; without any the training base rate is the score.
    """
    features = varying(train, features)
    if not features:
        return prior_score(train, test)
    filler = impute(train, features)
    cols = [f"{f}_i" for f in features]
    fit_rows = with_vector(with_balance(filler.transform(train)), cols, "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(fit_rows)
    scaled = scaler.transform(fit_rows)
    n = train.count()
    model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / (c * max(n, 1)),
                               standardization=False, maxIter=100).fit(scaled)
    scored = model.transform(scaler.transform(with_vector(filler.transform(test), cols, "raw")))
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def best_round(losses: Sequence[float], patience: int) -> int | None:
    """Number of rounds with the lowest loss (the fewest on ties) once ``patience`` later rounds have not beaten it, else None."""
    best = int(np.argmin(losses))
    return best + 1 if len(losses) - 1 - best >= patience else None


@dataclass(frozen=True)
class Boosted:
    """A fitted booster: the model, its features, and the held-out loss after each round tried."""

    model: object
    features: list[str]
    losses: list[float]
    filler: object

    def score(self, rows: DataFrame) -> DataFrame:
        flags, cols = _inputs(self.features)
        scored = self.model.transform(with_vector(self.filler.transform(rows).withColumns(flags), cols))
        return scored.withColumn("p", vector_to_array("probability")[1]).select(*rows.columns, "p")


def _inputs(features: Sequence[str]):
    flags = {f"{f}_m": F.col(f).isNull().cast("double") for f in features}
    return flags, [f"{f}_i" for f in features] + list(flags)


def fit_boosted(train: DataFrame, features: Sequence[str], params: dict | None = None, seed: int = SEED, patience: int = PATIENCE,
                max_rounds: int = MAX_ROUNDS) -> Boosted:
    """Gradient-boosted trees with as many rounds as the purged tail of the training dates asks for.

    The losses on the tail are looked at after half more rounds than ``patience``, then after twice as many each time, until ``patience`` rounds
    have not lowered them, or ``max_rounds`` is reached; the model kept is the one of the best round, cut from the longest fit.
    As the first look seldom ends the search, the first fit goes on to the second. Missing values take the training median and are
    flagged in a column of their own.

    A round is a few jobs of a fraction of a second, so the rows are dealt into as many tasks as their number asks for, by date and
    symbol and in that order: the trees depend on the rows and the seed, not on how the plan before happened to be cut.
    """
    settings = {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 20, **(params or {})}
    kept = varying(train, features)
    if not kept:
        raise ValueError("no feature varies in the training rows")
    filler = impute(train, kept)
    flags, cols = _inputs(kept)
    keys = [c for c in ("date", "symbol") if c in train.columns]
    held = chronological_holdout(train.select("date"))
    ready = with_balance(filler.transform(train), "positives").join(held, "date").withColumns(flags)
    ready = materialise(with_vector(ready, cols).select(*keys, "features", "y", "weight", "fit", "validate"), "boosting")
    tasks = max(1, math.ceil(ready.count() / ROWS_PER_TASK))
    rows = ready.where("fit").repartition(tasks, *keys).sortWithinPartitions(*keys, "y")
    tail = ready.where("validate").repartition(tasks, *keys).sortWithinPartitions(*keys, "y")

    def grow(rounds: int):
        booster = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", seed=seed, maxIter=rounds, **settings)
        return booster.fit(rows)

    look = min(max_rounds, patience + max(1, patience // 2))
    model, losses = None, []
    while True:
        if look > len(losses):
            model = grow(min(max_rounds, max(look, 2 * look if model is None else look)))
            losses = list(model.evaluateEachIteration(tail))
        best = best_round(losses[:look], patience)
        if best is None and look == max_rounds:
            best = int(np.argmin(losses)) + 1
        if best is not None:
            break
        look = min(max_rounds, 2 * look)
    return Boosted(first_rounds(model, best), kept, losses[:look], filler)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The booster as it was after its first ``rounds`` rounds."""
    java = model._java_obj
    build = SparkContext._active_spark_context._jvm.org.apache.spark.ml.classification.GBTClassificationModel
    return GBTClassificationModel(build(model.uid, java.trees()[:rounds], java.treeWeights()[:rounds]))


def boosted_trees(train: DataFrame, test: DataFrame, features: Sequence[str], params: dict | None = None, **how) -> tuple[DataFrame, Boosted]:
    """The scored test rows and the fitted booster."""
    fitted = fit_boosted(train, features, params, **how)
    return fitted.score(test), fitted


def gain_importance(fitted: Boosted, features: Sequence[str], spark) -> DataFrame:
    """Gain shares per feature; the missing flags count for their feature, features that never vary have none."""
    n = len(fitted.features)
    gains = np.zeros(2 * n)
    if fitted.model.totalNumNodes > fitted.model.getNumTrees:
        # a cut booster ends at the last feature it uses
        used = fitted.model.featureImportances.toArray()
        gains[:len(used)] = used
    both = dict(zip(fitted.features, gains[:n] + gains[n:]))
    total = sum(both.values()) or 1.0
    return spark.createDataFrame([(f, float(both.get(f, 0.0) / total)) for f in features], "feature string, importance double")


def random_params(n: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from conservative ranges; learning rates on a log scale.

    Trees grow level by level, so a bound on the leaves is a bound on the depth.
    """
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        leaves, depth = int(rng.integers(15, 256)), int(rng.integers(3, 11))
        out.append({
            "stepSize": float(np.exp(rng.uniform(np.log(0.01), np.log(0.2)))), "maxDepth": min(depth, int(np.log2(leaves))),
            "minInstancesPerNode": int(rng.integers(50, 1001)), "subsamplingRate": float(rng.uniform(0.5, 1.0)),
            "featureSubsetStrategy": f"{rng.uniform(0.4, 1.0):.3f}",
        })
    return out


def random_search(panel: DataFrame, folds: DataFrame, features: Sequence[str], trials: Sequence[dict], workers: int = WORKERS, **how) -> DataFrame:
    """Mean average precision of each trial over the inner folds, best first; trials and folds are fitted side by side."""
    spark = panel.sparkSession
    root = new_path(spark, "search")
    numbers = _fold_numbers(panel, folds)

    def job(i: int, f: int):
        def run() -> None:
            train, test = fold_rows(panel, folds, f)
            scored, _fitted = boosted_trees(train, test, features, trials[i], **how)
            scored.select("y", "p").write.mode("overwrite").parquet(f"{root}/trial={i}/fold={f}")
        return run

    run_side_by_side(spark, [job(i, f) for i in range(len(trials)) for f in numbers], workers)
    means = pr_auc(spark.read.parquet(root), ["trial", "fold"]).groupBy("trial").agg(F.avg("pr_auc").alias("mean_pr_auc"))
    names = ", ".join(f"{k} double" for k in sorted(trials[0]))
    drawn = spark.createDataFrame([(i, *[float(t[k]) for k in sorted(t)]) for i, t in enumerate(trials)], f"trial int, {names}")
    return means.join(drawn, "trial").orderBy(F.desc_nulls_last("mean_pr_auc"), "trial")


def run_side_by_side(spark, jobs: Sequence[Callable[[], None]], workers: int = WORKERS) -> None:
    """Run independent Spark jobs from a few driver threads; the first failure stops the others and is raised."""
    sc, tag = spark.sparkContext, f"barlab-{uuid.uuid4().hex}"

    def tagged(job: Callable[[], None]) -> None:
        sc.addJobTag(tag)
        try:
            job()
        finally:
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(tagged, j) for j in jobs]
        wait(futures, return_when=FIRST_EXCEPTION)
        failed = next((f.exception() for f in futures if f.done() and f.exception() is not None), None)
        if failed is not None:
            for f in futures:
                f.cancel()
            sc.cancelJobsWithTag(tag)
            raise failed


def fold_rows(panel: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Labelled training and test rows of one fold; the fold table holds dates only."""
    dates = folds.where(F.col("fold") == fold)
    rows = panel.where(F.col("y").isNotNull())

    def part(role: str) -> DataFrame:
        return rows.join(F.broadcast(dates.where(F.col("role") == role).select("date")), "date", "left_semi")

    return part("train"), part("test")


def _fold_numbers(panel: DataFrame, folds: DataFrame) -> list[int]:
    """Folds with both classes in their training rows; one class teaches nothing."""
    train = panel.where("y IS NOT NULL").join(folds.where("role = 'train'"), "date")
    rows = train.groupBy("fold").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").orderBy("fold").collect()
    return [r["fold"] for r in rows]


def prior_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The base rate of every fold's training rows for its test rows, all folds at once."""
    placed = panel.where("y IS NOT NULL").join(folds, "date")
    rates = placed.where("role = 'train'").groupBy("fold").agg(F.avg("y").alias("p"))
    return placed.where("role = 'test'").drop("role").join(rates, "fold")


def logit_folds(panel: DataFrame, folds: DataFrame, features: Sequence[str] = LOGIT_FEATURES, workers: int = WORKERS) -> DataFrame:
    """The logit of every fold on its test rows."""
    spark = panel.sparkSession
    root = new_path(spark, "logit")

    def job(f: int):
        def run() -> None:
            logit_baseline(*fold_rows(panel, folds, f), features).write.mode("overwrite").parquet(f"{root}/fold={f}")
        return run

    numbers = _fold_numbers(panel, folds)
    if not numbers:
        raise ValueError("no fold has both classes in its training rows")
    run_side_by_side(spark, [job(f) for f in numbers], workers)
    return spark.read.parquet(root)


def boosted_folds(panel: DataFrame, folds: DataFrame, features: Sequence[str], params: dict | None = None, root: str | None = None,
                  workers: int = WORKERS, **how) -> tuple[DataFrame, DataFrame]:
    """Scored test rows and gain shares of every fold's booster.

    Each fold is written when it ends. A later call with the same ``root`` skips the folds that are already whole, so a run
    that died goes on where it stopped; use a root only with the same panel, folds, features and parameters.
    """
    spark = panel.sparkSession
    root = root or new_path(spark, "boosted")

    def job(f: int):
        def run() -> None:
            if whole(spark, f"{root}/scores/fold={f}"):
                return
            train, test = fold_rows(panel, folds, f)
            scored, fitted = boosted_trees(train, test, features, params, **how)
            gain_importance(fitted, features, spark).write.mode("overwrite").parquet(f"{root}/gains/fold={f}")
            scored.write.mode("overwrite").parquet(f"{root}/scores/fold={f}")
        return run

    numbers = _fold_numbers(panel, folds)
    if not numbers:
        raise ValueError("no fold has both classes in its training rows")
    run_side_by_side(spark, [job(f) for f in numbers], workers)
    return spark.read.parquet(f"{root}/scores"), spark.read.parquet(f"{root}/gains")


def whole(spark, path: str) -> bool:
    """Whether a write to this folder has been committed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def walk_forward(panel: DataFrame, folds: DataFrame, features: Sequence[str], params: dict | None = None,
                 boosted: DataFrame | None = None, **how) -> DataFrame:
    """Every strategy on identical test blocks, as one long table of scores; folds that train on one class are left out.

    ``boosted`` takes the scores of ``boosted_folds`` where they exist already.
    """
    if boosted is None:
        boosted, _gains = boosted_folds(panel, folds, features, params, **how)
    logit = logit_folds(panel, folds, [f for f in LOGIT_FEATURES if f in panel.columns])
    tested = prior_folds(panel, folds).join(boosted.select("fold").distinct(), "fold", "left_semi")
    kept = ["symbol", "date", "y", *[c for c in ("fwd_abs_ret", "label_threshold") if c in panel.columns], "fold"]
    parts = {"prior": tested, "vol_cluster": vol_cluster_score(tested.drop("p")), "logit": logit, "boosted": boosted}
    pieces = [df.select(*kept, "p", F.lit(name).alias("strategy")) for name, df in parts.items()]
    return materialise(reduce(DataFrame.unionByName, pieces), "predictions", ["strategy"])
