"""Trades from triggers: stops, targets, the first barrier touched, and metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import hhmm, to_minutes
from barlab.functions.windows import nonzero
from barlab.operators.joins import latest_at_or_before

EPS = 1e-9


@dataclass(frozen=True)
class TradeConfig:
    """Fixed default values of the trade rules."""

    huge_mult: float = 2.0
    stop_max: float = 0.01
    target_r: float = 3.0
    breakeven_r: float = 2.0
    force_close: str = "15:00"


KEY = ["symbol", "date", "k", "direction", "trigger_t"]


def choose_stop(found: DataFrame) -> DataFrame:
    """The farther of swing body and third bar back; the third wins only when strictly farther."""
    swing, third = F.col("stop_dist_swing_body_pct"), F.col("stop_dist_thirdback_pct")
    use_third = third.isNotNull() & (swing.isNull() | (third > swing))
    return found.withColumns({
        "stop_price": F.when(use_third, F.col("third_back_stop_price")).otherwise(F.col("swing_stop_price_body")),
        "stop_dist_pct": F.when(use_third, third).otherwise(swing),
        "stop_source": F.when(use_third, "third_back").when(swing.isNotNull(), "swing_body").otherwise("none"),
    })


def momentum_filters(found: DataFrame, bars: DataFrame) -> DataFrame:
    """A: the first bar's extreme held up to the entry bar. B: entry on its side of the open."""
    w = Window.partitionBy("symbol", "d").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol", "d")
    held = bars.select(
        "symbol", F.col("d").alias("date"), F.col("t").alias("trigger_t"),
        (F.min("low").over(upto) >= F.min_by("low", "t").over(whole) - EPS).alias("_low_held"),
        (F.max("high").over(upto) <= F.min_by("high", "t").over(whole) + EPS).alias("_high_held"),
    )
    out = found.join(held, ["symbol", "date", "trigger_t"])
    long = F.col("direction") == "long"
    side = F.when(long, F.col("entry_price") > F.col("open_0915")).otherwise(F.col("entry_price") < F.col("open_0915"))
    return out.withColumns({
        "filterA_ok": F.when(long, F.col("_low_held")).otherwise(F.col("_high_held")), "filterB_ok": side,
    }).drop("_low_held", "_high_held")


def qualifiers(found: DataFrame, cfg: TradeConfig) -> DataFrame:
    return found.withColumns({
        "qual_huge": F.coalesce(F.col("atr_ratio") <= cfg.huge_mult, F.lit(False)),
        "qual_stop": F.coalesce(F.col("stop_dist_pct") <= cfg.stop_max, F.lit(False)),
    })


def targets(found: DataFrame, cfg: TradeConfig) -> DataFrame:
    """Risk unit, target and breakeven price; null where the stop does not qualify."""
    entry = F.col("entry_price")
    risk = F.when(F.col("qual_stop"), F.abs(entry - F.col("stop_price")))
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    out = found.withColumn("R_unit", risk)
    return out.withColumns({
        "target_price": entry + sign * F.col("R_unit") * cfg.target_r,
        "be_price": entry + sign * F.col("R_unit") * cfg.breakeven_r,
    })


def prepare(found: DataFrame, bars: DataFrame, cfg: TradeConfig) -> DataFrame:
    return targets(qualifiers(momentum_filters(choose_stop(found), bars), cfg), cfg)


def resolve(prepared: DataFrame, bars: DataFrame, cfg: TradeConfig, breakeven: bool = False) -> DataFrame:
    """Walk each qualifying trade to its first barrier.

    A trade meets the later bars of its own (symbol, day) only; the earliest
    bar per rule is a conditional minimum, so there is no bar-by-bar state.
    With ``breakeven`` the stop moves to the entry after the first bar that
    touches the breakeven price.
    """
    trade = prepared.where("qual_stop").select(*KEY, "entry_price", "stop_price", "target_price", "be_price", "R_unit")
    later = bars.select("symbol", F.col("d").alias("date"), "t", *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")])
    joined = trade.join(later, ["symbol", "date"]).where(F.col("t") > F.col("trigger_t"))
    long = F.col("direction") == "long"
    forced = F.col("t") >= to_minutes(cfg.force_close)
    favour = F.when(long, F.col("_high") >= F.col("be_price")).otherwise(F.col("_low") <= F.col("be_price"))
    if breakeven:
        arm = F.min(F.when(favour, F.col("t"))).over(Window.partitionBy(*KEY))
        joined = joined.withColumn("_armed", F.coalesce(F.col("t") > arm, F.lit(False)))
    else:
        joined = joined.withColumn("_armed", F.lit(False))
    stop = F.when(F.col("_armed"), F.col("entry_price")).otherwise(F.col("stop_price"))
    hit_stop = F.when(long, F.col("_low") <= stop).otherwise(F.col("_high") >= stop)
    hit_target = F.when(long, F.col("_high") >= F.col("target_price")).otherwise(F.col("_low") <= F.col("target_price"))
    t = F.col("t")
    first = joined.groupBy(*KEY).agg(
        F.min(F.when(forced, t)).alias("_forced"), F.min_by(F.when(forced, F.col("_open")), F.when(forced, t)).alias("_forced_open"),
        F.min(F.when(~forced & hit_stop, t)).alias("_stop"), F.min(F.when(~forced & hit_target, t)).alias("_target"),
        F.min_by(F.when(~forced & hit_stop, F.col("_armed")), F.when(~forced & hit_stop, t)).alias("_stop_armed"),
        F.max("t").alias("_last"), F.max_by("_close", "t").alias("_last_close"),
    )
    # both barriers in one bar: the stop counts
    stopped = F.col("_stop").isNotNull() & (F.col("_target").isNull() | (F.col("_stop") <= F.col("_target")))
    won = F.col("_target").isNotNull()
    at_entry = F.coalesce("_stop_armed", F.lit(False))
    out = prepared.join(first, KEY, "left")
    stop_px = F.when(at_entry, F.col("entry_price")).otherwise(F.col("stop_price"))
    price = (
        F.when(stopped, stop_px).when(won, F.col("target_price"))
        .when(F.col("_forced").isNotNull(), F.col("_forced_open")).otherwise(F.coalesce("_last_close", "entry_price"))
    )
    moment = (
        F.when(stopped, F.col("_stop")).when(won, F.col("_target")).otherwise(F.coalesce("_forced", "_last", "trigger_t"))
    )
    reason = F.when(stopped, F.when(at_entry, "breakeven").otherwise("stop")).when(won, "target").otherwise("time")
    sign = F.when(long, 1.0).otherwise(-1.0)
    ok = F.col("qual_stop")
    out = out.withColumns({
        "exit_price": F.when(ok, price), "exit_time": F.when(ok, hhmm(moment)), "exit_reason": F.when(ok, reason),
        "tie_stopfirst": ok & F.coalesce(stopped & (F.col("_stop") == F.col("_target")), F.lit(False)),
        "_won": won & ~stopped,
    })
    gained = F.when(F.col("_won"), F.lit(cfg.target_r)).otherwise(sign * (F.col("exit_price") - F.col("entry_price")) / nonzero(F.col("R_unit")))
    out = out.withColumn("realized_R", F.when(ok, gained))
    return out.drop("_forced", "_forced_open", "_stop", "_target", "_stop_armed", "_last", "_last_close", "_won")


def select_trades(resolved: DataFrame, filters: Sequence[str] = ("A", "B")) -> DataFrame:
    """The first fully qualifying trigger of each day, for each momentum filter in one pass."""
    passed = F.array_compact(F.array(*[F.when(F.col(f"filter{f}_ok"), F.lit(f)) for f in filters]))
    q = resolved.where(F.col("qual_huge") & F.col("qual_stop")).withColumn("filter", F.explode(passed))
    w = Window.partitionBy("filter", "date").orderBy("trigger_t", "r_rank", "symbol", "direction")
    return q.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_governing_rank(resolved: DataFrame, basket: DataFrame, checkpoints: Sequence[str]) -> DataFrame:
    """Rank in the basket of the latest checkpoint at or before the trigger; 99 when not in it."""
    gov = latest_at_or_before([to_minutes(c) for c in checkpoints], F.col("trigger_t"))
    out = resolved.withColumn("gov_checkpoint", F.when(gov.isNotNull(), hhmm(gov)))
    out = out.join(basket.withColumnRenamed("checkpoint", "gov_checkpoint"), ["date", "gov_checkpoint", "symbol"], "left")
    return out.withColumns({
        "rolling_ok": F.col("rank_at_cp").isNotNull(), "rank_at_cp": F.coalesce("rank_at_cp", F.lit(99)),
    })


def select_rolling(governed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first qualifying trigger of each day whose symbol leads at its governing checkpoint."""
    q = governed.where(F.col("qual_huge") & F.col("qual_stop") & F.col("filterA_ok") & F.col("rolling_ok"))
    w = Window.partitionBy(*keys, "date").orderBy("trigger_t", "rank_at_cp", "symbol", "direction")
    return q.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


METRICS = (
    "n_trades", "no_trade_days", "expectancy_R", "total_R", "win_rate", "avg_win_R", "avg_loss_R", "pct_target", "pct_stop",
    "pct_breakeven", "pct_time", "n_breakeven", "time_close_mean_R", "max_drawdown_R", "max_dd_duration_trades",
    "longest_losing_streak", "avg_stop_dist_pct", "n_long", "n_short", "n_tie_stopfirst",
)


def trade_metrics(log: DataFrame, variant: str, n_days: Column) -> DataFrame:
    """Headline metrics per variant; a log holds at most one trade per day and variant.

    Equity, drawdown and losing runs all come from one window order, so the
    log is sorted once and aggregated once.
    """
    r = F.col("realized_R")
    w = Window.partitionBy(variant).orderBy("date")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    curve = log.withColumns({"_i": F.row_number().over(w), "_eq": F.sum(r).over(upto)})
    curve = curve.withColumns({"_peak": F.max("_eq").over(upto), "_old": F.max("_eq").over(before)})
    new_peak = F.col("_old").isNull() | (F.col("_eq") > F.col("_old"))
    curve = curve.withColumns({
        "_peak_i": F.last(F.when(new_peak, F.col("_i")), ignorenulls=True).over(upto),
        "_safe_i": F.last(F.when(F.coalesce(r >= 0, F.lit(True)), F.col("_i")), ignorenulls=True).over(upto),
    })
    # the first of the deepest points, with the distance to its peak
    depth = F.struct((F.col("_peak") - F.col("_eq")).alias("dd"), (-F.col("_i")).alias("i"), (F.col("_i") - F.col("_peak_i")).alias("span"))
    n = F.count(F.lit(1))
    by_reason = {x: F.count_if(F.col("exit_reason") == x) for x in ("target", "stop", "breakeven", "time")}
    out = curve.groupBy(variant).agg(
        n.alias("n_trades"), F.avg(r).alias("expectancy_R"), F.sum(r).alias("total_R"),
        (F.count_if(r > 0) / n).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win_R"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss_R"),
        *[(c / n).alias(f"pct_{x}") for x, c in by_reason.items()], by_reason["breakeven"].alias("n_breakeven"),
        F.avg(F.when(F.col("exit_reason") == "time", r)).alias("time_close_mean_R"), F.max(depth).alias("_deep"),
        F.max(F.col("_i") - F.coalesce("_safe_i", F.lit(0))).alias("longest_losing_streak"),
        F.avg("stop_dist_pct").alias("avg_stop_dist_pct"), F.count_if(F.col("direction") == "long").alias("n_long"),
        F.count_if(F.col("direction") == "short").alias("n_short"), F.count_if("tie_stopfirst").alias("n_tie_stopfirst"),
    )
    return out.withColumns({
        "no_trade_days": n_days - F.col("n_trades"), "max_drawdown_R": F.col("_deep.dd"), "max_dd_duration_trades": F.col("_deep.span"),
    }).drop("_deep")


def compare_variants(metrics: DataFrame, variant: str, values: Sequence[str]) -> DataFrame:
    """Metrics as rows, variants as columns."""
    long = metrics.select(variant, *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot([variant], list(METRICS), "metric", "value")
    return long.groupBy("metric").pivot(variant, list(values)).agg(F.first("value"))


def best_variant(metrics: DataFrame, variant: str) -> DataFrame:
    """The variant of highest expectancy, the last name of equals; no row where no variant traded."""
    first = metrics.orderBy(F.desc_nulls_last("expectancy_R"), F.desc(variant)).limit(1)
    return first.select(F.col(variant).alias("best"), "expectancy_R")


def trade_log(parts: Sequence[DataFrame]) -> DataFrame:
    """Stacked logs with display rounding and a win or loss tag."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    tag = F.when(F.col("realized_R") > 0, "win").when(F.col("realized_R") < 0, "loss").otherwise("")
    return out.withColumn("result", tag).withColumns({
        **{c: F.bround(c, 2) for c in ("level_price", "entry_price", "stop_price", "target_price")},
        "stop_dist_pct": F.bround(F.col("stop_dist_pct") * 100, 2),
        **{c: F.bround(c, 3) for c in ("R_unit", "atr_ratio", "realized_R")},
    })
