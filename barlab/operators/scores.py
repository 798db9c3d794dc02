"""Binary-score metrics as aggregates over distinct scores.

Equal scores are collapsed first, and running counts go through range-split
totals, so neither a large block nor a constant score ends up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.ordering import with_row_number, with_running
from barlab.functions.windows import correlation, nonzero

# The top shares at which precision is reported.
TOP_RATES = (0.01, 0.05, 0.10)


def usable(df: DataFrame) -> DataFrame:
    """Rows with a label and a finite score."""
    return df.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))


def _by_score(df: DataFrame, keys: Sequence[str], descending: bool) -> DataFrame:
    counted = usable(df).groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    order = -F.col("p") if descending else F.col("p")
    return with_running(counted, keys, order, {"cum_pos": F.col("pos"), "cum_n": F.col("n")})


def pr_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average precision: recall steps times precision, from the highest score down."""
    steps = _by_score(df, keys, True)
    return steps.groupBy(*keys).agg(
        (F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / nonzero(F.sum("pos"))).alias("pr_auc")
    )


def roc_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    up = _by_score(df, keys, False)
    neg = F.col("n") - F.col("pos")
    below = F.col("cum_n") - F.col("cum_pos") - neg
    return up.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (below + neg / 2)) / nonzero(F.sum("pos") * F.sum(neg))).alias("roc_auc")
    )


def _clip(p: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(p, F.lit(high)), F.lit(low))


def pointwise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, base rate, Brier score and log loss."""
    y, p = F.col("y"), _clip(F.col("p"), 1e-7, 1 - 1e-7)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return usable(df).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"),
        F.avg(F.pow(y - _clip(F.col("p"), 0.0, 1.0), F.lit(2.0))).alias("brier"), F.avg(loss).alias("log_loss"),
    )


def precision_at_k(df: DataFrame, keys: Sequence[str], tie: Column, rates: Sequence[float] = TOP_RATES) -> DataFrame:
    """Positive rate and lift among the top share by score; equal scores go by ``tie``."""
    rows = usable(df)
    ranked = with_row_number(rows, keys, -F.col("p"), tie, "_rn")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("y").alias("_base"))
    if keys:
        joined = ranked.join(sizes, list(keys))
    else:
        joined = ranked.withColumn("_z", sizes.select(F.struct("_n", "_base")).scalar()).select("*", "_z.*")
    aggs = []
    for r in rates:
        top = F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * r))
        name = f"{r * 100:g}"
        prec = F.avg(F.when(top, F.col("y")))
        aggs += [prec.alias(f"prec_{name}"), (prec / nonzero(F.max("_base"))).alias(f"lift_{name}")]
    return joined.groupBy(*keys).agg(*aggs)


def score_blocks(df: DataFrame, keys: Sequence[str], tie: Column) -> DataFrame:
    """The full metric set per block; ranking metrics are null where only one class is present."""
    out = pointwise(df, keys)
    for part in (pr_auc(df, keys), roc_auc(df, keys), precision_at_k(df, keys, tie)):
        out = out.join(part, list(keys), "left")
    mixed = (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    shown = [c for c in out.columns if c not in (*keys, "n", "base_rate")]
    out = out.withColumns({c: F.when(mixed, F.col(c)) for c in shown})
    return out.withColumn("pr_auc_lift", F.col("pr_auc") / nonzero(F.col("base_rate")))


def aggregate_folds(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-weighted means over usable blocks, and the spread of the average precision."""
    ok = blocks.where(F.col("pr_auc").isNotNull())
    names = [c for c in ("base_rate", "pr_auc", "pr_auc_lift", "roc_auc", "brier", "log_loss") if c in blocks.columns]
    names += [c for c in blocks.columns if c.startswith(("prec_", "lift_"))]
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n_rows"),
        *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in names], F.stddev_pop("pr_auc").alias("pr_auc_std"),
    )


def calibration_table(df: DataFrame, keys: Sequence[str], tie: Column, bins: int = 10) -> DataFrame:
    """Mean score against observed rate per rank-based bin."""
    rows = usable(df)
    ranked = with_row_number(rows, keys, F.col("p"), tie, "_rn")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = ranked.join(sizes, list(keys)) if keys else ranked.withColumn("_n", sizes.scalar())
    place = F.least(F.floor(F.col("_rn") / F.col("_n") * bins), F.lit(bins - 1)).cast("int")
    return joined.groupBy(*keys, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("observed")
    )


def summarise(totals: DataFrame, strategy: str, references: dict[str, str]) -> DataFrame:
    """Strategies best first, with their average precision over each reference strategy's."""
    out = totals
    for column, name in references.items():
        base = totals.where(F.col(strategy) == name).select("pr_auc").limit(1).scalar()
        out = out.withColumn(column, F.col("pr_auc") / nonzero(base))
    return out.orderBy(F.desc("pr_auc"), strategy)


def direction_table(df: DataFrame, features: Sequence[str], prediction: str) -> DataFrame:
    """Correlation of each feature with the prediction; monotone beyond 0.5 either way."""
    one = df.agg(*[correlation(F.col(f).cast("double"), F.col(prediction)).alias(f) for f in features])
    out = one.unpivot([], list(features), "feature", "value_corr")
    c = F.col("value_corr")
    return out.withColumn("effect", F.when(c > 0.5, "monotone +").when(c < -0.5, "monotone -").otherwise("non-monotone"))
