"""Queries over the run registry: strategies, categories, tests, runs and insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def categories(cats: DataFrame, strategies: DataFrame) -> DataFrame:
    return cats.join(strategies.select("strategy_id", "strategy_name"), "strategy_id").select(
        "strategy_id", "strategy_name", "category_id", "category_name", "display_order"
    )


def tests_with_category(tests: DataFrame, cats: DataFrame) -> DataFrame:
    return tests.join(cats.select("category_id", "category_name", "strategy_id"), "category_id")


def run_history(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs per test and instrument, newest first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run_at"), F.desc("run_id"))
    return runs.withColumn("nth", F.row_number().over(w))


def latest_run(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest successful run; a max over a struct folds on the map side."""
    done = runs.where(F.col("status") == "success")
    last = done.groupBy(*keys).agg(F.max(F.struct("run_at", "run_id")).alias("_m"))
    return last.select(*keys, "_m.run_at", "_m.run_id")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "important", 2).otherwise(3)


def all_insights(insights: DataFrame, runs: DataFrame, tests: DataFrame, cats: DataFrame, strategies: DataFrame) -> DataFrame:
    """Insights of successful runs with their test and strategy and the display rank of the severity."""
    out = insights.join(runs.where(F.col("status") == "success").select("run_id", "test_id"), "run_id")
    out = out.join(tests.select("test_id", "test_name", "category_id"), "test_id")
    out = out.join(cats.select("category_id", "strategy_id"), "category_id").join(strategies.select("strategy_id", "strategy_name"), "strategy_id")
    return out.withColumn("severity_rank", severity_rank(F.col("severity")))


def test_completion(tests: DataFrame, cats: DataFrame, runs: DataFrame) -> DataFrame:
    """Tests and completed tests per strategy."""
    done = runs.where(F.col("status") == "success").select("test_id").distinct().withColumn("_done", F.lit(1))
    joined = tests.join(cats.select("category_id", "strategy_id"), "category_id").join(done, "test_id", "left")
    return joined.groupBy("strategy_id").agg(F.count_distinct("test_id").alias("total"), F.count("_done").alias("completed"))


def insight_diff(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed, added, removed or equal per insight key of two runs."""
    a = one.select(*keys, F.col("value").alias("value_1"), F.lit(True).alias("_in1"))
    b = two.select(*keys, F.col("value").alias("value_2"), F.lit(True).alias("_in2"))
    out = a.join(b, list(keys), "full")
    state = (
        F.when(F.col("_in1").isNull(), "added").when(F.col("_in2").isNull(), "removed")
        .when(~F.col("value_1").eqNullSafe(F.col("value_2")), "changed").otherwise("same")
    )
    return out.withColumn("state", state).drop("_in1", "_in2")


def insight_counts(insights: DataFrame, keys: Sequence[str]) -> DataFrame:
    s = F.col("severity")
    return insights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x) for x in ("critical", "important", "info")]
    )


def run_rollup(runs: DataFrame, insights: DataFrame) -> DataFrame:
    """Runs and insights per test; insights are counted per run before the join."""
    per_run = insights.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(per_run, "run_id", "left").groupBy("test_id").agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("insights")
    )
