"""Leakage-safe splits made on dates, never on rows.

The distinct dates of a panel are bounded by the calendar; numbering them in
one small window gives every split as conditions on date positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.windows import one_series

# Fixed values of the protocol.
HORIZON, EMBARGO, MIN_TRAIN, N_FOLDS, N_INNER = 1, 10, 250, 6, 3
FIRST_TEST_SHARE, DEV_SHARE, HOLDOUT_SHARE = 0.35, 0.60, 0.15


def date_positions(panel: DataFrame, day: str = "date") -> DataFrame:
    """Distinct dates with their zero-based position ``p`` and their number ``n``."""
    dates = panel.select(day).distinct()
    numbered = dates.withColumn("p", F.row_number().over(one_series(day)) - 1)
    return numbered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))


def gap_days(horizon: int = HORIZON, embargo: int = EMBARGO, purge: int = HORIZON) -> int:
    if embargo < 0 or horizon < 1:
        raise ValueError("horizon must be at least 1 and embargo at least 0")
    return max(horizon, purge) + embargo


def dev_eval_split(panel: DataFrame, fraction: float = DEV_SHARE, horizon: int = HORIZON, embargo: int = EMBARGO) -> DataFrame:
    """Dates tagged dev, gap or eval; eval starts a full embargo after dev ends."""
    pos = date_positions(panel)
    cut = F.floor(F.col("n") * fraction)
    start = F.least(cut + embargo + horizon, F.col("n") - 1)
    role = F.when(F.col("p") < cut, "dev").when(F.col("p") >= start, "eval").otherwise("gap")
    return pos.select("date", role.alias("role"))


def purged_walk_forward(
    panel: DataFrame,
    n_folds: int = N_FOLDS,
    horizon: int = HORIZON,
    embargo: int = EMBARGO,
    expanding: bool = True,
    min_train: int = MIN_TRAIN,
) -> DataFrame:
    """Rows (fold, role, date): equal test blocks at the end of the timeline.

    Training ends a gap before its test block; the last block takes the
    remainder. Too few dates raise when the plan runs.
    """
    gap = gap_days(horizon, embargo)
    need = min_train + n_folds * (gap + 1)
    pos = date_positions(panel)
    n, p = F.col("n"), F.col("p")
    checked = pos.withColumn(
        "n", F.when(n < need, F.raise_error(F.concat(n.cast("string"), F.lit(f" dates are too few for {n_folds} folds with a gap of {gap}"))))
        .otherwise(n).cast("long"),
    )
    first = F.greatest(F.lit(min_train + gap), F.floor(n * FIRST_TEST_SHARE))
    block = F.floor((n - first) / n_folds)
    grid = checked.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    fold = F.col("fold")
    test_lo = first + fold * block
    test_hi = F.when(fold == n_folds - 1, n - 1).otherwise(first + (fold + 1) * block - 1)
    train_hi = test_lo - gap - 1
    train_lo = F.lit(0) if expanding else F.greatest(F.lit(0), train_hi - min_train * 2 + 1)
    kept = (train_hi - train_lo + 1 >= min_train) & (test_hi >= test_lo)
    role = F.when(p.between(test_lo, test_hi), "test").when(p.between(train_lo, train_hi), "train")
    return grid.withColumn("role", F.when(kept, role)).where(F.col("role").isNotNull()).select("fold", "role", "date")


def inner_folds(panel: DataFrame, train_dates: DataFrame, n_folds: int = N_INNER, horizon: int = HORIZON,
                embargo: int = EMBARGO, min_train: int | None = None) -> DataFrame:
    """The same splitter inside a training block."""
    least = max(60, MIN_TRAIN // 3) if min_train is None else min_train
    return purged_walk_forward(panel.join(train_dates.select("date").distinct(), "date", "left_semi"), n_folds, horizon, embargo, True, least)


def chronological_holdout(train_dates: DataFrame, fraction: float = HOLDOUT_SHARE, horizon: int = HORIZON,
                          embargo: int = EMBARGO) -> DataFrame:
    """Dates with the flags ``fit`` and ``validate``; a block that is too short serves as both."""
    gap = gap_days(horizon, embargo)
    pos = date_positions(train_dates)
    start = F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") * fraction))
    fit_hi = start - gap - 1
    short = fit_hi < 1
    return pos.select(
        "date", (short | (F.col("p") <= fit_hi)).alias("fit"), (short | (F.col("p") >= start)).alias("validate")
    )


def leakage_report(folds: DataFrame, panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Per fold: shared dates, ends of train and test, dates in the gap, and whether the contract holds."""
    pos = date_positions(panel).select("date", "p")
    placed = folds.join(F.broadcast(pos), "date")
    per_date = placed.groupBy("fold", "date", "p").agg(F.count_distinct("role").alias("roles"))
    shared = per_date.groupBy("fold").agg(F.count_if(F.col("roles") > 1).alias("shared_dates"))
    ends = placed.groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("p"))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col("p"))).alias("test_start"),
        F.count_if(F.col("role") == "train").alias("train_dates"), F.count_if(F.col("role") == "test").alias("test_dates"),
    )
    out = ends.join(shared, "fold").withColumn("gap_dates", F.col("test_start") - F.col("train_end") - 1)
    return out.withColumn("clean", (F.col("shared_dates") == 0) & (F.col("train_end") < F.col("test_start")) & (F.col("gap_dates") >= horizon))


def assert_no_leakage(folds: DataFrame, panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The report, or an error naming the first fold that leaks when the plan runs."""
    report = leakage_report(folds, panel, horizon)
    bad: Column = F.raise_error(F.concat(F.lit("leakage in fold "), F.col("fold").cast("string")))
    return report.withColumn("clean", F.when(F.col("clean"), F.lit(True)).otherwise(bad.cast("boolean")))
