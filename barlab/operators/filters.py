"""Row filters, corporate-action handling and column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import finite, minutes, to_minutes

PRICES = ("open", "high", "low", "close")


def session_filter(bars: DataFrame, session_open: str, session_end: str, ts: str = "ts") -> DataFrame:
    """Bars whose time of day is in [open, end]."""
    return bars.where(minutes(F.col(ts)).between(to_minutes(session_open), to_minutes(session_end)))


def positive_prices(bars: DataFrame, columns: tuple[str, ...] = PRICES) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & (F.col(c) > 0)
    return bars.where(keep)


def split_ts(bars: DataFrame, ts: str = "ts", source_zone: str | None = None, market_zone: str = "Asia/Kolkata") -> DataFrame:
    """Add date ``d`` and minute of day ``t``; a zoned source is first moved to the market zone."""
    local = F.col(ts).cast("timestamp_ntz")
    if source_zone is not None:
        local = F.convert_timezone(F.lit(source_zone), F.lit(market_zone), local)
    moved = bars.withColumn(ts, local)
    return moved.withColumn("d", F.col(ts).cast("date")).withColumn("t", minutes(F.col(ts)))


def apply_corporate_actions(df: DataFrame, actions: DataFrame, mode: str = "exclude", day: str = "d") -> DataFrame:
    """Handle rows on a symbol's ex-date: drop them, flag them or leave them."""
    if mode not in ("exclude", "flag", "ignore"):
        raise ValueError(f"unknown mode {mode!r}; expected exclude, flag or ignore")
    if mode == "ignore":
        return df
    dates = actions.select("symbol", F.col("ex_date").alias(day)).distinct()
    if mode == "exclude":
        return df.join(dates, ["symbol", day], "left_anti")
    flagged = df.join(dates.withColumn("_hit", F.lit(True)), ["symbol", day], "left")
    return flagged.withColumn("is_corp_action", F.coalesce("_hit", F.lit(False))).drop("_hit")


def mask_returns(df: DataFrame, ret: str, flag: str, order: str) -> DataFrame:
    """Null the return on a flagged row and on the row after it."""
    w = Window.partitionBy("symbol").orderBy(order)
    hit = F.col(flag) | F.lag(flag, 1, False).over(w)
    return df.withColumn(ret, F.when(~hit, F.col(ret)))


def null_inf(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def fill_defaults(df: DataFrame, columns: list[str], ratios: list[str]) -> DataFrame:
    """Neutral values for missing features: 1 for ratios, 0 for the rest."""
    return df.na.fill({c: (1.0 if c in ratios else 0.0) for c in columns})


def in_dates(df: DataFrame, keep: DataFrame | None = None, drop: DataFrame | None = None, day: str = "date") -> DataFrame:
    """Rows whose date is in ``keep`` and not in ``drop``."""
    out = df
    if keep is not None:
        out = out.join(keep.select(day).distinct(), day, "left_semi")
    if drop is not None:
        out = out.join(drop.select(day).distinct(), day, "left_anti")
    return out


BOOKKEEPING = {"symbol", "date", "open", "high", "low", "close", "volume", "prev_close", "index_close",
               "intraday_bar_count", "y"}
LABEL_PREFIXES = ("fwd_", "label_", "target_")


def feature_columns(df: DataFrame) -> list[str]:
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [
        name for name, kind in df.dtypes
        if kind in numeric and name not in BOOKKEEPING and not name.startswith(LABEL_PREFIXES)
    ]


def feature_usability(df: DataFrame, min_share: float = 0.01) -> DataFrame:
    """One row per candidate feature: share filled, whether it varies, whether it is usable.

    Min and max decide whether a column is constant, which one pass with
    map-side combine answers for all columns at once.
    """
    columns = feature_columns(df)
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[(F.min(c) < F.max(c)).alias(f"v_{c}") for c in columns],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (F.col(f"n_{c}") / F.col("_n")).alias("filled"),
            F.coalesce(F.col(f"v_{c}"), F.lit(False)).alias("varies"),
        )
        for c in columns
    ])
    out = stats.select(F.inline(rows))
    return out.withColumn("usable", (F.col("filled") >= min_share) & F.col("varies"))


def text_filter(df: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring match over every column."""
    joined = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    return df.where(F.contains(F.lower(joined), F.lit(needle.lower())))


def any_over(columns: list[str], test) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | test(F.col(c))
    return out
