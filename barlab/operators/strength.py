"""Relative strength against benchmarks and the lift of strength-based selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.scalars import label, to_minutes
from barlab.functions.windows import correlation, nonzero
from barlab.operators.aggregates import percentile_set, quantile_bins
from barlab.operators.joins import through_membership

EPS = 1e-9


# membership


def membership_map(constituents: DataFrame, universe: DataFrame, broad: str) -> DataFrame:
    """A sector row per list a symbol is on, and one broad row for every symbol.

    Both come out of one row a symbol. A union of two parts that are dealt by
    symbol would keep them so, and fails where adaptive execution gives the parts
    different numbers of partitions.
    """
    known = universe.select("symbol").distinct()
    on = F.struct("benchmark_index", F.lit("sector").alias("membership_type"))
    lists = constituents.select(F.explode("symbols").alias("symbol"), "benchmark_index").groupBy("symbol").agg(F.collect_list(on).alias("_on"))
    every = F.array(F.struct(F.lit(broad).alias("benchmark_index"), F.lit("broad").alias("membership_type")))
    return known.join(lists, "symbol", "left").select("symbol", F.inline(F.concat(F.coalesce("_on", F.slice(every, 1, 0)), every)))


def sector_profile(members: DataFrame, index_members: DataFrame | None = None) -> DataFrame:
    """Number of sectors per symbol, whether it has none, and the index-member flag."""
    out = members.groupBy("symbol").agg(F.count_if(F.col("membership_type") == "sector").alias("n_sectors"))
    out = out.withColumn("no_sector", F.col("n_sectors") == 0)
    if index_members is None:
        return out
    hit = index_members.select("symbol").distinct().withColumn("_hit", F.lit(True))
    return out.join(hit, "symbol", "left").withColumn("index_member", F.coalesce("_hit", F.lit(False))).drop("_hit")


# values


def move_from_open(bars: DataFrame, key: str) -> DataFrame:
    """Move of each close from the first open of its session."""
    first = F.min_by("open", "t").over(Window.partitionBy(key, "d"))
    moved = bars.select(key, "ts", "d", "t", "close", first.alias("_open")).where(F.col("_open") != 0)
    return moved.withColumn("move", (F.col("close") - F.col("_open")) / F.col("_open")).drop("_open", "close")


def rs_values(bars: DataFrame, members: DataFrame, bench: DataFrame, timeframe: str) -> DataFrame:
    """Stock move minus benchmark move at the same time, per membership."""
    joined = through_membership(move_from_open(bars, "symbol"), members, move_from_open(bench, "benchmark_index"), "move")
    return joined.select(
        "symbol", "ts", "d", "t", "membership_type", "benchmark_index",
        (F.col("move") - F.col("bench_move")).alias("rs_value"), F.lit(timeframe).alias("timeframe"),
    )


def rs_counts(rs: DataFrame) -> DataFrame:
    return rs.groupBy("timeframe", "membership_type", "benchmark_index").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
        F.min("d").alias("first_d"), F.max("d").alias("last_d"),
    )


def index_coverage(bench: DataFrame, members: DataFrame) -> DataFrame:
    """Rows and date span per benchmark, with its member count (0 when it has none)."""
    spans = bench.groupBy("benchmark_index").agg(
        F.count(F.lit(1)).alias("rows"), F.min("d").alias("first_d"), F.max("d").alias("last_d")
    )
    sizes = members.groupBy("benchmark_index").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(sizes, "benchmark_index", "left").withColumn("members", F.coalesce("n", F.lit(0))).drop("n")


def _cp_rows(checkpoints: Sequence[str], fields: dict[str, str]) -> Column:
    """Array of (checkpoint, fields) from columns named by prefix and checkpoint."""
    return F.array(*[
        F.struct(F.lit(c).alias("checkpoint"), *[F.col(f"{p}_{label(c)}").alias(n) for n, p in fields.items()])
        for c in checkpoints
    ])


def rs_at_checkpoints(rs: DataFrame, checkpoints: Sequence[str]) -> DataFrame:
    """Per symbol and day: maximum sector value and mean broad value over everything up to a checkpoint.

    One conditional aggregate stands in for two aggregates and a full join.
    """
    aggs = []
    for c in checkpoints:
        upto = F.col("t") <= to_minutes(c)
        aggs += [
            F.max(F.when(upto & (F.col("membership_type") == "sector"), F.col("rs_value"))).alias(f"rs_sect_{label(c)}"),
            F.avg(F.when(upto & (F.col("membership_type") == "broad"), F.col("rs_value"))).alias(f"rs_mkt_{label(c)}"),
        ]
    return rs.groupBy("symbol", "d").agg(*aggs)


def rs_last_at_checkpoint(rs: DataFrame, checkpoints: Sequence[str]) -> DataFrame:
    """The last value at or before a checkpoint per benchmark, then max over sectors and mean over broad ones."""
    last = rs.groupBy("symbol", "d", "membership_type", "benchmark_index").agg(*[
        F.max_by(F.when(F.col("t") <= to_minutes(c), F.col("rs_value")),
                 F.when(F.col("t") <= to_minutes(c), F.col("t"))).alias(f"v_{label(c)}")
        for c in checkpoints
    ])
    aggs = []
    for c in checkpoints:
        v = F.col(f"v_{label(c)}")
        aggs += [
            F.max(F.when(F.col("membership_type") == "sector", v)).alias(f"rs_sect_{label(c)}"),
            F.avg(F.when(F.col("membership_type") == "broad", v)).alias(f"rs_mkt_{label(c)}"),
        ]
    return last.groupBy("symbol", "d").agg(*aggs)


def rs_exact_at(rs: DataFrame, at: str) -> DataFrame:
    """Values at exactly one time of day: max over sectors, mean over broad benchmarks."""
    now = rs.where(F.col("t") == to_minutes(at))
    return now.groupBy("symbol", "d").agg(
        F.max(F.when(F.col("membership_type") == "sector", F.col("rs_value"))).alias("RS_sector"),
        F.avg(F.when(F.col("membership_type") == "broad", F.col("rs_value"))).alias("RS_market"),
    )


def extreme_held(bars: DataFrame, checkpoints: Sequence[str], opening: str) -> DataFrame:
    """Whether the opening bar's low (high) is still the extreme at each checkpoint."""
    first = F.col("t") == to_minutes(opening)
    aggs = [F.min(F.when(first, F.col("low"))).alias("_low0"), F.max(F.when(first, F.col("high"))).alias("_high0")]
    for c in checkpoints:
        upto = F.col("t") <= to_minutes(c)
        aggs += [F.min(F.when(upto, F.col("low"))).alias(f"_lo_{label(c)}"), F.max(F.when(upto, F.col("high"))).alias(f"_hi_{label(c)}")]
    days = bars.where(F.col("t") >= to_minutes(opening)).groupBy("symbol", "d").agg(*aggs).where(F.col("_low0").isNotNull())
    flags = {}
    for c in checkpoints:
        flags[f"fa_long_{label(c)}"] = F.coalesce(F.col(f"_lo_{label(c)}") >= F.col("_low0") - EPS, F.lit(False))
        flags[f"fa_short_{label(c)}"] = F.coalesce(F.col(f"_hi_{label(c)}") <= F.col("_high0") + EPS, F.lit(False))
    return days.select("symbol", "d", *[x.alias(n) for n, x in flags.items()])


def eval_frame(top: DataFrame, at_cp: DataFrame, held: DataFrame, checkpoints: Sequence[str]) -> DataFrame:
    """Picks with the strength and the held flag of their checkpoint and direction."""
    strength = at_cp.select("symbol", F.col("d").alias("date"), F.inline(_cp_rows(checkpoints, {"RS_sector": "rs_sect", "RS_market": "rs_mkt"})))
    flags = held.select("symbol", F.col("d").alias("date"), F.inline(_cp_rows(checkpoints, {"_long": "fa_long", "_short": "fa_short"})))
    keys = ["symbol", "date", "checkpoint"]
    out = top.join(strength, keys, "left").join(flags, keys, "left")
    held_ok = F.when(F.col("direction_at_checkpoint") == "up", F.col("_long")).otherwise(F.col("_short"))
    return out.withColumn("filterA_ok", held_ok).drop("_long", "_short")


# selection methods


def _methods() -> dict[str, list[tuple[Column, Column | None, int]]]:
    """Per method the options in order of preference: condition, descending key (None for rank), rows needed."""
    held = F.coalesce(F.col("filterA_ok"), F.lit(False))
    everyone = (F.lit(True), None, 1)
    out = {"B0_R_alone": [everyone], "B1_R_filterA": [(held, None, 1), everyone]}
    for prefix, name, rs in (("S1", "sector", F.col("RS_sector")), ("S2", "market", F.col("RS_market"))):
        there = rs.isNotNull()
        out[f"{prefix}_{name}_filter"] = [(rs > 0, None, 1), (there, None, 1), everyone]
        out[f"{prefix}_{name}_rank"] = [(there, rs, 1), everyone]
        out[f"{prefix}_{name}_abs_rank"] = [(there, F.abs(rs), 1), everyone]
        out[f"S4_filterA_{name}RS"] = [(held & there, rs, 1), (held, None, 1), (there, rs, 1), everyone]
        out[f"S5_{name}RS_nofilter"] = [(there, rs, 1), everyone]
    sector, market = F.col("RS_sector"), F.col("RS_market")
    out["S3_both_filter"] = [((sector > 0) & (market > 0), None, 3), ((sector > 0) | (market > 0), None, 1), everyone]
    both = F.coalesce(sector, F.lit(0.0)) + F.coalesce(market, F.lit(0.0))
    out["S3_both_rank"] = [(sector.isNotNull() | market.isNotNull(), both, 1), everyone]
    return out


def select_by_method(frame: DataFrame, top_n: int) -> DataFrame:
    """Every method's ordered selection from the candidates of each (date, checkpoint).

    Each candidate is offered under the options it satisfies; a group takes
    the first option that has enough rows. Candidates are already limited to
    the leaderboard, so the offered rows per group are few.
    """
    offers = []
    for method, options in _methods().items():
        for i, (condition, key, need) in enumerate(options):
            score = F.lit(0.0) if key is None else -key
            offer = F.struct(F.lit(method).alias("method"), F.lit(i).alias("option"), F.lit(need).alias("need"),
                             score.cast("double").alias("score"))
            offers.append(F.when(F.coalesce(condition, F.lit(False)), offer))
    offered = frame.withColumn("_o", F.explode(F.array_compact(F.array(*offers)))).select("*", "_o.*").drop("_o")
    group = Window.partitionBy("date", "checkpoint", "method")
    depth = max(len(o) for o in _methods().values())
    at = [F.col("option") == i for i in range(depth)]
    needed = [F.coalesce(F.max(F.when(x, F.col("need"))).over(group), F.lit(1)) for x in at]
    chosen = F.least(*[F.when(F.count_if(x).over(group) >= n, i) for i, (x, n) in enumerate(zip(at, needed))])
    kept = offered.withColumn("_chosen", chosen).where(F.col("option") == F.col("_chosen"))
    ranked = kept.withColumn("pos", F.row_number().over(group.orderBy("score", "r_rank")))
    return ranked.where(F.col("pos") <= top_n).drop("_chosen", "option", "need", "score")


def method_curves(selected: DataFrame, rate: Column, top_sub: int) -> DataFrame:
    """Per method, day and checkpoint: pick counts, hit rates and lift."""
    hit = F.col("hit_2pct").cast("double")
    first = F.col("pos") <= top_sub
    curves = selected.groupBy("method", "date", "checkpoint").agg(
        F.count(F.lit(1)).alias("n_picks"), F.avg(hit).alias("hit_rate"),
        F.count_if(first).alias("n_picks_top5"), F.avg(F.when(first, hit)).alias("hit_rate_top5"),
    ).withColumn("base_rate", rate)
    return curves.withColumns({"lift": F.col("hit_rate") - F.col("base_rate"), "lift_top5": F.col("hit_rate_top5") - F.col("base_rate")})


def best_of_day(selected: DataFrame) -> DataFrame:
    return selected.where("pos = 1").select(
        "method", "date", "checkpoint", "symbol", "r_rank", "r_factor", "RS_sector", "RS_market",
        F.col("direction_at_checkpoint").alias("direction"), "hit_2pct", "max_up_pct", "max_down_pct", "open_0915",
    )


def lift_summary(curves: DataFrame) -> DataFrame:
    """Mean of daily rates per method and checkpoint, and the distance to the two baselines."""
    out = curves.groupBy("method", "checkpoint").agg(
        F.sum("n_picks").alias("n_total_picks"), F.avg("hit_rate").alias("hit_rate"), F.max("base_rate").alias("base_rate"),
        F.avg("lift").alias("lift"), F.sum("n_picks_top5").alias("n_total_top5"),
        F.avg("hit_rate_top5").alias("hit_rate_top5"), F.avg("lift_top5").alias("lift_top5"),
    )
    at = Window.partitionBy("checkpoint")
    for short, method in (("B0", "B0_R_alone"), ("B1", "B1_R_filterA")):
        base = F.max(F.when(F.col("method") == method, F.col("lift"))).over(at)
        out = out.withColumn(f"lift_delta_vs_{short}", F.col("lift") - base)
    return out


def pooled_methods(summary: DataFrame) -> DataFrame:
    return summary.groupBy("method").agg(
        F.sum("n_total_picks").alias("n_total_picks"), F.avg("hit_rate").alias("hit_rate"), F.max("base_rate").alias("base_rate"),
        F.avg("lift").alias("lift"), F.avg("hit_rate_top5").alias("hit_rate_top5"), F.avg("lift_top5").alias("lift_top5"),
        F.avg("lift_delta_vs_B0").alias("lift_delta_vs_B0"), F.avg("lift_delta_vs_B1").alias("lift_delta_vs_B1"),
    )


def lift_pivot(summary: DataFrame, methods: Sequence[str]) -> DataFrame:
    return summary.groupBy("checkpoint").pivot("method", list(methods)).agg(F.avg("lift"))


# sanity and relevance


def rs_distribution(rs: DataFrame) -> DataFrame:
    moments = rs.groupBy("membership_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rs_value").alias("mean"), F.stddev_samp("rs_value").alias("std"),
        F.min("rs_value").alias("min"), F.max("rs_value").alias("max"),
        F.count_if(F.abs("rs_value") > 0.5).alias("extreme"),
    )
    return moments.join(percentile_set(rs, ["membership_type"], "rs_value", [.05, .25, .5, .75, .95]), "membership_type")


def rs_alignment(rs: DataFrame, times: Sequence[str]) -> DataFrame:
    """Spread of broad values by time of day; it should grow through the session."""
    at = rs.where((F.col("membership_type") == "broad") & F.col("t").isin([to_minutes(t) for t in times]))
    return at.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rs_value").alias("mean"), F.stddev_samp("rs_value").alias("std")
    )


def rs_relevance(days: DataFrame, exact: DataFrame) -> DataFrame:
    """Hit rate of positive and non-positive strength, and their correlation, per measure."""
    merged = days.where("eligible").join(exact.withColumnRenamed("d", "date"), ["symbol", "date"], "left")
    rate = merged.agg(F.avg(F.col("hit_2pct").cast("double"))).scalar()
    long = merged.select(F.col("hit_2pct").cast("double").alias("hit"), "RS_sector", "RS_market").unpivot(
        ["hit"], ["RS_sector", "RS_market"], "measure", "rs"
    ).where(F.col("rs").isNotNull())
    out = long.groupBy("measure").agg(
        F.count_if(F.col("rs") > 0).alias("n_pos"), F.avg(F.when(F.col("rs") > 0, F.col("hit"))).alias("pos_hit"),
        F.count_if(F.col("rs") <= 0).alias("n_neg"), F.avg(F.when(F.col("rs") <= 0, F.col("hit"))).alias("neg_hit"),
        correlation(F.col("rs"), F.col("hit")).alias("corr"),
    ).withColumn("base_rate", rate)
    return out.withColumns({"pos_lift": F.col("pos_hit") - F.col("base_rate"), "neg_lift": F.col("neg_hit") - F.col("base_rate")})


def rs_quartiles(days: DataFrame, exact: DataFrame, measure: str) -> DataFrame:
    merged = days.where("eligible").join(exact.withColumnRenamed("d", "date"), ["symbol", "date"], "left").where(F.col(measure).isNotNull())
    return quantile_bins(merged, measure, 4).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hit_2pct").cast("double")).alias("hit_rate")
    )


def sector_share(members: DataFrame) -> DataFrame:
    return members.groupBy("membership_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
        (F.count(F.lit(1)) / nonzero(F.count_distinct("symbol"))).alias("per_symbol"),
    )
