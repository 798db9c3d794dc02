"""Forward labels, their validity and ex-date contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlab.functions.windows import series

MIN_HISTORY = 60


def event_within(flag: Column, horizon: int, w: WindowSpec) -> Column:
    """Any flagged row from now to ``horizon`` rows ahead; false once that runs past the end."""
    ahead = F.max(F.coalesce(flag, F.lit(False))).over(w.rowsBetween(0, horizon))
    complete = F.lead(F.lit(True), horizon).over(w)
    return F.coalesce(complete & ahead, F.lit(False))


def contamination_by_position(days: DataFrame, actions: DataFrame, lookback: int, day: str) -> DataFrame:
    """Flag the rows whose look-back window holds an ex-date of their symbol.

    From the first row on or after the ex-date, ``lookback + 1`` rows are
    flagged, one less when the symbol has no row on the ex-date itself. The
    ex-dates are stacked into the day series as marker rows, so one window
    order per symbol answers it without joining rows to each other.
    """
    markers = actions.select("symbol", F.col("ex_date").alias(day)).distinct().withColumn("_real", F.lit(0))
    laid = days.withColumn("_real", F.lit(1)).unionByName(markers, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy(day, "_real")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumns({"_pos": F.sum("_real").over(upto), "_next": F.lead(day).over(w)})
    # a marker sorts before a row of its own date and points at the row after it
    reach = F.col("_pos") + 1 + F.when(F.col("_next") == F.col(day), lookback).otherwise(lookback - 1)
    laid = laid.withColumn("_until", F.max(F.when(F.col("_real") == 0, reach)).over(upto))
    flagged = laid.where("_real = 1").withColumn("contaminated", F.coalesce(F.col("_pos") <= F.col("_until"), F.lit(False)))
    return flagged.drop("_real", "_pos", "_next", "_until")


def add_labels(
    panel: DataFrame,
    actions: DataFrame,
    horizon: int = 1,
    vol_multiple: float = 2.0,
    scale: str = "rvol_20d",
    min_history: int = MIN_HISTORY,
) -> DataFrame:
    """Forward return, its threshold and the label ``y`` (null where not valid)."""
    if scale not in panel.columns:
        raise KeyError(f"scale column {scale!r} is not in the panel")
    w = series()
    dates = actions.select("symbol", F.col("ex_date").alias("date")).distinct().withColumn("_corp", F.lit(True))
    df = panel.join(dates, ["symbol", "date"], "left")
    corp = F.coalesce("_corp", F.lit(False))
    df = df.withColumns({
        "fwd_ret": F.lead("close", horizon).over(w) / F.col("close") - 1,
        "label_threshold": F.col(scale) * F.lit(float(horizon)) ** 0.5 * vol_multiple,
        "label_scale_feature": F.lit(scale),
        "_bar": F.row_number().over(w) - 1,
        "_dirty": corp | event_within(corp, horizon, w),
    })
    valid = (
        F.col("fwd_ret").isNotNull()
        & F.coalesce(F.col("label_threshold") > 0, F.lit(False))
        & (F.col("_bar") >= min_history)
        & ~F.col("_dirty")
    )
    df = df.withColumn("fwd_abs_ret", F.abs("fwd_ret")).withColumn("label_valid", valid)
    hit = (F.col("fwd_abs_ret") > F.col("label_threshold")).cast("double")
    return df.withColumn("y", F.when(F.col("label_valid"), hit)).drop("_bar", "_dirty", "_corp")


def label_summary(labelled: DataFrame) -> DataFrame:
    return labelled.where("label_valid").groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("y").alias("base_rate"),
        F.avg("label_threshold").alias("mean_threshold"),
        F.avg("fwd_abs_ret").alias("mean_abs_fwd_ret"),
    )
