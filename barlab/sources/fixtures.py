"""Bars, benchmarks, calendars and registries derived from the test tables.

Every ordered first/last uses a total order, so results do not depend on how
the input is split.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.sources.layout import buckets_for, laid_out

# Three symbols with ex-dates, one of them on a day without a bar.
CORPORATE_ACTIONS = [
    ("S1", "1996-03-15", "split", 2.0),
    ("S3", "1998-07-09", "bonus", 1.5),
    ("S5", "1996-01-12", "split", 5.0),
    ("S1", "2024-01-12", "bonus", 1.5),
    ("S3", "2024-01-20", "split", 2.0),
]

#: Least price of an order whose event has high or medium impact.
IMPACT_PRICES = {"high": 480_000, "medium": 400_000}

# Ten weekdays without trading.
HOLIDAYS = [
    ("1995-01-26", "Founders day"),
    ("1995-08-15", "Harvest day"),
    ("1996-01-26", "Founders day"),
    ("1996-10-02", "Lantern day"),
    ("1997-03-28", "Spring day"),
    ("1998-05-01", "Labour day"),
    ("1999-08-16", "Harvest day"),
    ("2000-12-25", "Winter day"),
    ("2001-01-26", "Founders day"),
    ("2024-01-26", "Founders day"),
]


def packed(ts: str, number: str) -> Column:
    """A timestamp and a non-negative 64-bit number as one ordered decimal.

    16 digits of microseconds and 19 of the number fit 38; a fixed-width order
    keeps first and last inside a hash aggregate instead of a sorted one.
    """
    since = F.col(ts) - F.lit("1970-01-01").cast("timestamp_ntz")
    micros = (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("decimal(18,0)")
    shifted = (micros * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)")
    return (shifted + F.col(number).cast("decimal(19,0)")).cast("decimal(38,0)")


def ticks_to_bars(
    ticks: DataFrame, keys: list[str], price: str, volume: Column, order: list[str] | Column
) -> DataFrame:
    """Open, high, low, close and volume per key; first and last by ``order``."""
    at = order if isinstance(order, Column) else F.struct(*order) if len(order) > 1 else F.col(order[0])
    return ticks.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        volume.cast("long").alias("volume"),
    )


class Fixtures:
    """Lazy frames over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # bars

    @cached_property
    def bars_daily(self) -> DataFrame:
        ticks = self.table("lineitem").select(
            F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        )
        order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
        return ticks_to_bars(ticks, ["symbol", "date"], "price", F.sum("l_quantity"), order)

    @cached_property
    def _event_ticks(self) -> DataFrame:
        hour = F.col("ts").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
        return self.table("events").select(
            F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
            hour.alias("bar"), "ts", "event_id", "event_type", F.col("value").alias("price"),
        )

    @cached_property
    def bars_intraday(self) -> DataFrame:
        """Hourly bars with the columns symbol, ts, d, t (minutes) and OHLCV."""
        bars = ticks_to_bars(
            self._event_ticks.withColumnRenamed("ts", "at"), ["symbol", "bar"], "price",
            F.count(F.lit(1)), packed("at", "event_id"),
        )
        return _clocked(bars, ["symbol"])

    def by_day(self) -> Fixtures:
        """The same frames with the hourly bars laid out by symbol and day, for queries that use them several times."""
        out = Fixtures(self.spark, self.folder)
        # an hourly bar holds at least one event; parquet counts rows without reading them
        buckets = buckets_for(self.table("events").count())
        out.bars_intraday = laid_out(self.bars_intraday, ["symbol", "d"], ["t"], buckets)
        return out

    @cached_property
    def bench_intraday(self) -> DataFrame:
        """One series per event type and one, ALL, over every event."""
        ticks = self._event_ticks.withColumnRenamed("ts", "at")
        scopes = F.explode(F.array(F.col("event_type"), F.lit("ALL")))
        bars = ticks_to_bars(
            ticks.withColumn("benchmark_index", scopes), ["benchmark_index", "bar"], "price",
            F.count(F.lit(1)), packed("at", "event_id"),
        )
        return _clocked(bars, ["benchmark_index"])

    @cached_property
    def index_intraday(self) -> DataFrame:
        return self.bench_intraday.where(F.col("benchmark_index") == "ALL").drop("benchmark_index")

    @cached_property
    def index_session(self) -> DataFrame:
        """Hourly index bars, 09:15 to 15:15, on the dates of ``index_daily``."""
        slot = (F.lit(9) + F.col("o_orderkey") % 7).cast("int")
        orders = self.table("orders").select(
            (F.col("o_orderdate").cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=slot, mins=F.lit(15))).alias("bar"),
            "o_orderkey", F.col("o_totalprice").alias("price"),
        )
        return _clocked(ticks_to_bars(orders, ["bar"], "price", F.count(F.lit(1)), ["o_orderkey"]), [])

    @cached_property
    def index_daily(self) -> DataFrame:
        orders = self.table("orders").select(
            F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", F.col("o_totalprice").alias("price")
        )
        return ticks_to_bars(orders, ["date"], "price", F.count(F.lit(1)), ["o_orderkey"])

    @cached_property
    def vix_daily(self) -> DataFrame:
        """A volatility level per date with at least two orders; opens at the previous close."""
        level = (
            self.table("orders")
            .groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                (F.stddev_samp("o_totalprice") / F.avg("o_totalprice") * 25).alias("close"),
            )
            .where("n >= 2")
        )
        by_date = Window.partitionBy(F.lit(0)).orderBy("date")
        opened = F.coalesce(F.lag("close").over(by_date), F.col("close"))
        return level.select(
            "date", opened.alias("open"), F.greatest(opened, "close").alias("high"),
            F.least(opened, "close").alias("low"), "close",
        )

    # dimensions

    @cached_property
    def constituents(self) -> DataFrame:
        """One row per sector benchmark with the list of its member symbols."""
        sectors = self.table("events").select(F.col("event_type").alias("benchmark_index")).distinct()
        i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("benchmark_index")) - 1
        members = F.array_except(
            F.array(
                F.concat(F.lit("S"), i.cast("string")),
                F.concat(F.lit("S"), ((i + 4) % 5).cast("string")),
            ),
            F.array(F.lit("S4")),
        )
        return sectors.select("benchmark_index", members.alias("symbols"))

    @cached_property
    def universe(self) -> DataFrame:
        return self.bars_intraday.select("symbol").distinct()

    @cached_property
    def event_calendar(self) -> DataFrame:
        """Every urgent order is an event; its price sets the impact."""
        price = F.col("o_totalprice")
        return self.table("orders").where("o_orderpriority = '1-URGENT'").select(
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_orderstatus").alias("event_type"),
            F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
            F.when(price >= IMPACT_PRICES["high"], "high").when(price >= IMPACT_PRICES["medium"], "medium").otherwise("low").alias("impact_level"),
        )

    @cached_property
    def holidays(self) -> DataFrame:
        return self._literal(HOLIDAYS, ["date", "holiday_name"]).withColumn("date", F.to_date("date"))

    @cached_property
    def corp_actions(self) -> DataFrame:
        rows = self._literal(CORPORATE_ACTIONS, ["symbol", "ex_date", "action_type", "ratio"])
        return rows.withColumn("ex_date", F.to_date("ex_date"))

    def _literal(self, rows: list[tuple], names: list[str]) -> DataFrame:
        """A constant relation, whose size the planner knows."""
        structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
        return self.spark.range(1).select(F.inline(F.array(*structs)))


def _clocked(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.select(
        *keys, F.col("bar").alias("ts"), F.col("bar").cast("date").alias("d"),
        (F.hour("bar") * 60 + F.minute("bar")).alias("t"),
        "open", "high", "low", "close", "volume",
    )
