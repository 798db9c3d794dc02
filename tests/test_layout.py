"""Tables laid out by key: the same results without exchanges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlab.sources.layout import buckets_for, laid_out


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bars(spark, n=4000):
    one_day = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50)  # half of the rows on one day
    return spark.range(n).select(
        F.when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("S"), F.col("id") % 3)).alias("symbol"),
        one_day.cast("int").alias("d"), F.col("id").alias("t"), (F.col("id") * 37 % 101).cast("double").alias("close"),
    )


def step(df):
    w = Window.partitionBy("symbol", "d").orderBy("t")
    return df.withColumn("change", F.col("close") - F.lag("close").over(w))


def test_windows_aggregates_and_joins_by_the_key_need_no_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = bars(spark)
        laid = laid_out(plain, ["symbol", "d"], ["t"], 8)

        def work(df):
            ends = df.groupBy("symbol", "d").agg(F.max_by("close", "t").alias("end"), F.count(F.lit(1)).alias("n"))
            return step(df).join(ends, ["symbol", "d"]).select("symbol", "d", "t", "change", "end", "n")

        assert "Exchange" not in plan(work(laid))
        assert "Exchange" in plan(work(plain))
        key = ["symbol", "d", "t"]
        assert work(laid).orderBy(key).collect() == work(plain).orderBy(key).collect()
        assert step(laid).where("symbol is null").count() == plain.where("symbol is null").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_file_a_bucket_and_an_empty_table(spark):
    laid = laid_out(bars(spark), ["symbol", "d"], ["t"], 8)
    assert len(laid.inputFiles()) <= 8
    assert laid_out(bars(spark).where("false"), ["symbol", "d"], ["t"], 8).count() == 0
    assert buckets_for(0) == buckets_for(10) == 8
    assert buckets_for(10_000_001) == 11
