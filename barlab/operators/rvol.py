"""Relative-volume ranking: who trades unusually much by a checkpoint, and what happened next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import direction_case, label, share, to_minutes
from barlab.functions.windows import nonzero
from barlab.operators.aggregates import checkpoint_columns
from barlab.operators.labels import contamination_by_position
from barlab.operators.selection import top_per_group


@dataclass(frozen=True)
class RankingConfig:
    """Fixed default values of the ranking."""

    checkpoints: tuple[str, ...] = ("09:25", "09:45", "10:00", "10:15", "10:30", "10:45", "11:00", "11:15", "11:30")
    top_n: int = 10
    top_subset: int = 5
    lookback: int = 20
    move_threshold: float = 0.02
    capture_bar: float = 0.0075
    min_bars: int = 300
    close_after: str = "15:20"
    degenerate_share: float = 0.5


def trading_calendar(bars: DataFrame, symbol: str) -> DataFrame:
    """Distinct dates of one liquid symbol."""
    return bars.where(F.col("symbol") == symbol).select("d").distinct()


def symbol_days(bars: DataFrame, checkpoints: Sequence[str], threshold: float) -> DataFrame:
    """One row per symbol and day, checkpoints as columns.

    The day open comes from a window over (symbol, d), whose exchange the
    aggregate reuses, so the bars are shuffled once.
    """
    day = Window.partitionBy("symbol", "d")
    opened = bars.withColumn("_open", F.min_by("open", "t").over(day))
    touched = (F.col("high") >= F.col("_open") * (1 + threshold)) | (F.col("low") <= F.col("_open") * (1 - threshold))
    return opened.groupBy("symbol", "d").agg(
        F.min_by("open", "t").alias("open_0915"),
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        F.max_by("close", "t").alias("session_close"),
        F.count(F.lit(1)).alias("n_candles"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        *checkpoint_columns(checkpoints),
        F.min(F.when(touched, F.col("t"))).alias("time_first_hit"),
    )


def normal_session(min_bars: int, close_after: str) -> Column:
    return F.coalesce(
        F.col("open_0915").isNotNull() & (F.col("n_candles") >= min_bars) & (F.col("last_t") >= to_minutes(close_after)),
        F.lit(False),
    )


def baseline_over(days: DataFrame, condition: Column, values: dict[str, Column], lookback: int, day: str = "d") -> DataFrame:
    """Mean of the ``lookback`` prior rows that meet ``condition``, on rows that meet it too.

    Partitioning by the condition as well lets the frame skip the other rows
    without a filter and a join back.
    """
    flagged = days.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    frame = Window.partitionBy("symbol", "_ok").orderBy(day).rowsBetween(-lookback, -1)
    full = {
        name: F.when(F.col("_ok") & (F.count(x).over(frame) == lookback), F.avg(x).over(frame)) for name, x in values.items()
    }
    return flagged.withColumns(full).drop("_ok")


def day_table(bars: DataFrame, actions: DataFrame, cfg: RankingConfig) -> DataFrame:
    """Symbol-days with baselines, R per checkpoint, eligibility and day outcomes."""
    days = symbol_days(bars, cfg.checkpoints, cfg.move_threshold)
    # windows by symbol come first; the baseline's finer key then needs no exchange of its own
    days = contamination_by_position(days, actions, cfg.lookback, "d").withColumnRenamed("contaminated", "corp_contaminated")
    days = days.withColumn("normal_session", normal_session(cfg.min_bars, cfg.close_after))
    volumes = {}
    for cp in cfg.checkpoints:
        cv = F.col(f"cv_{label(cp)}")
        volumes[f"cv_{label(cp)}"] = F.when(F.col("normal_session"), F.coalesce(cv, F.lit(0))).otherwise(cv)
    days = days.withColumns(volumes)
    days = baseline_over(
        days, F.col("normal_session"), {f"base_{label(c)}": F.col(f"cv_{label(c)}") for c in cfg.checkpoints}, cfg.lookback
    )
    first = label(cfg.checkpoints[0])
    opened = F.col("open_0915")
    days = days.withColumns({
        **{f"r_{label(c)}": F.col(f"cv_{label(c)}") / nonzero(F.col(f"base_{label(c)}")) for c in cfg.checkpoints},
        "eligible": F.col("normal_session") & F.col(f"base_{first}").isNotNull() & ~F.col("corp_contaminated"),
        "max_up_pct": (F.col("day_high") - opened) / nonzero(opened),
        "max_down_pct": (opened - F.col("day_low")) / nonzero(opened),
    })
    up, down = F.col("max_up_pct") >= cfg.move_threshold, F.col("max_down_pct") >= cfg.move_threshold
    return days.withColumns({
        "hit_2pct": F.coalesce(up | down, F.lit(False)), "hit_direction": direction_case(up, down),
    }).withColumnRenamed("d", "date")


def checkpoint_rows(days: DataFrame, cfg: RankingConfig) -> DataFrame:
    """One row per symbol, day and checkpoint with the capture outcome."""
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("checkpoint"), F.lit(i).alias("step"), F.col(f"cv_{label(c)}").alias("cv"),
            F.col(f"base_{label(c)}").alias("baseline"), F.col(f"r_{label(c)}").alias("r_factor"),
            F.col(f"px_{label(c)}").alias("price_at_checkpoint"), F.col(f"hi_after_{label(c)}").alias("hi_after"),
            F.col(f"lo_after_{label(c)}").alias("lo_after"),
        )
        for i, c in enumerate(cfg.checkpoints)
    ])
    kept = ["date", "symbol", "open_0915", "day_high", "day_low", F.col("session_close").alias("close"), "max_up_pct",
            "max_down_pct", "hit_2pct", "hit_direction", "time_first_hit", "eligible"]
    long = days.select(*kept, F.inline(rows))
    px = F.col("price_at_checkpoint")
    up = F.coalesce(px >= F.col("open_0915"), F.lit(False))
    gain = F.when(up, F.col("hi_after") - px).otherwise(px - F.col("lo_after")) / nonzero(px)
    return long.withColumns({
        "direction_at_checkpoint": F.when(up, "up").otherwise("down"),
        "fav_move_after_cp_pct": gain,
        "capturable": F.coalesce(gain >= cfg.capture_bar, F.lit(False)),
    })


def with_rank(long: DataFrame) -> DataFrame:
    """Rank among the eligible rows of a (date, checkpoint); null for the others."""
    ranked = F.col("eligible") & F.col("r_factor").isNotNull()
    w = Window.partitionBy("date", "checkpoint", "_in").orderBy(F.desc("r_factor"), "symbol")
    return long.withColumn("_in", ranked).withColumn("r_rank", F.when(F.col("_in"), F.row_number().over(w))).drop("_in")


def degenerate_days(days: DataFrame, universe_size: Column, cfg: RankingConfig) -> DataFrame:
    """Days on which too few symbols are eligible."""
    return days.groupBy("date").agg(F.count_if("eligible").alias("n_eligible")).where(
        F.col("n_eligible") < universe_size * cfg.degenerate_share
    )


def ranked_top(long: DataFrame, n: int) -> DataFrame:
    """The first ``n`` per (date, checkpoint); only ``n`` rows per group and task are shuffled."""
    pool = long.where(F.col("eligible") & F.col("r_factor").isNotNull())
    return top_per_group(pool, ["date", "checkpoint"], [F.desc("r_factor"), F.col("symbol")], n, "r_rank")


def picks(long: DataFrame, cfg: RankingConfig) -> DataFrame:
    """The frozen leaderboard of every (date, checkpoint)."""
    top = ranked_top(long, cfg.top_n).withColumn("in_top5", F.col("r_rank") <= cfg.top_subset)
    return top.drop("hi_after", "lo_after", "day_high", "day_low", "eligible")


# analytics: rates are pooled over all days


def base_rate(days: DataFrame) -> DataFrame:
    return days.where("eligible").agg(F.avg(F.col("hit_2pct").cast("double")).alias("base_rate"))


def hit_rate_curve(top: DataFrame, days: DataFrame) -> DataFrame:
    rate = base_rate(days).scalar()
    curve = top.groupBy("checkpoint").agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.avg(F.col("hit_2pct").cast("double")).alias("topn_hit"),
        F.avg(F.when(F.col("in_top5"), F.col("hit_2pct").cast("double"))).alias("top5_hit"),
    )
    out = curve.withColumn("base_rate", rate)
    return out.withColumns({"lift_topn": F.col("topn_hit") - F.col("base_rate"), "lift_top5": F.col("top5_hit") - F.col("base_rate")})


def capturable_curve(top: DataFrame) -> DataFrame:
    """At most top-n picks per day and checkpoint, so the median buffer is bounded by the calendar."""
    return top.groupBy("checkpoint").agg(
        F.median("fav_move_after_cp_pct").alias("median_fav_move"),
        F.avg("fav_move_after_cp_pct").alias("mean_fav_move"),
        share(F.col("capturable")).alias("pct_capturable"),
    )


def churn_curve(top: DataFrame, cfg: RankingConfig) -> DataFrame:
    """Mean share of a day's picks still listed at the next checkpoint."""
    from barlab.operators.sets import overlap_with_next

    names = F.array(*[F.lit(c) for c in cfg.checkpoints])
    kept = overlap_with_next(top, ["date"], "symbol", "step").where(F.col("step") < len(cfg.checkpoints) - 1)
    out = kept.groupBy("step").agg(F.avg("persistence").alias("persistence"))
    return out.select(
        F.get(names, F.col("step")).alias("checkpoint"), F.get(names, F.col("step") + 1).alias("next_checkpoint"),
        "persistence", (1 - F.col("persistence")).alias("churn"),
    )


def picks_per_day(top: DataFrame) -> DataFrame:
    return top.groupBy("date", "checkpoint").agg(
        F.count_if("hit_2pct").alias("n_hits"), F.count(F.lit(1)).alias("n_picks")
    )


def direction_split(top: DataFrame) -> DataFrame:
    hit = F.col("hit_2pct")
    share_of = {f"pct_{d}": F.avg(F.when(hit, (F.col("hit_direction") == d).cast("double"))) for d in ("up", "down", "both")}
    return top.groupBy("checkpoint").agg(F.count_if(hit).alias("n_hits"), *[x.alias(n) for n, x in share_of.items()])


def magnitude_distribution(top: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    thresholds = thresholds or {"pct_ge_2": 0.02, "pct_ge_3": 0.03, "pct_ge_5": 0.05}
    moved = top.withColumn("_m", F.greatest("max_up_pct", "max_down_pct"))
    return moved.groupBy("checkpoint").agg(
        *[share(F.col("_m") >= t).alias(n) for n, t in thresholds.items()], F.median("_m").alias("median_abs_move")
    )


def verdict_summary(top: DataFrame, days: DataFrame, cfg: RankingConfig) -> DataFrame:
    """Hit, base, lift, capture and churn per checkpoint in one table.

    The picks of a date are brought together once; staying on and the size of
    each day's list are windows there, and one aggregate gives every figure.
    """
    one = F.lit(1)
    listed = Window.partitionBy("date", "checkpoint")
    stays = F.lead("step").over(Window.partitionBy("date", "symbol").orderBy("step")) == F.col("step") + 1
    placed = top.repartition("date").withColumns({
        "_size": F.count(one).over(listed), "_stays": F.coalesce(stays, F.lit(False)).cast("double"),
    })
    hit = F.col("hit_2pct").cast("double")
    n_days = F.count_if(F.col("r_rank") == 1)
    rest = 1 - F.sum(F.col("_stays") / F.col("_size")) / n_days  # mean over days of the share that stays
    out = placed.groupBy("checkpoint").agg(
        F.count(one).alias("n_picks"), F.avg(hit).alias("topn_hit"), F.avg(F.when(F.col("in_top5"), hit)).alias("top5_hit"),
        base_rate(days).scalar().alias("base_rate"), F.median("fav_move_after_cp_pct").alias("median_fav_move"),
        share(F.col("capturable")).alias("pct_capturable"), (F.count_if("hit_2pct") / n_days).alias("mean_picks_hit"),
        F.when(F.max("step") < len(cfg.checkpoints) - 1, rest).alias("churn"),
    )
    lifts = {f"lift_{x}": F.col(f"{x}_hit") - F.col("base_rate") for x in ("topn", "top5")}
    return out.withColumns(lifts)


def leaderboard(long: DataFrame, top_n: int, basket: int) -> DataFrame:
    top = ranked_top(long, top_n)
    return top.select("date", "checkpoint", "r_rank", "symbol", "r_factor", "cv", "baseline",
                      (F.col("r_rank") <= basket).alias("in_basket"))


def day_grid(board: DataFrame, top_n: int) -> DataFrame:
    """One row per (date, checkpoint), the symbol of each rank as a column."""
    grid = board.groupBy("date", "checkpoint").pivot("r_rank", list(range(1, top_n + 1))).agg(F.first("symbol"))
    return grid.withColumnsRenamed({str(i): f"rank_{i}" for i in range(1, top_n + 1)})
