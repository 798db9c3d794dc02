"""Reading and writing bar tables and the small registries around them.

Bars live in one Parquet table partitioned by asset type and timeframe, and by
year below them so that a date range prunes folders; symbols are a sorted
column, not folders, because thousands of tiny files per symbol do not scale.
Replaced folders are switched by a manifest (see ``versions``), so a write that
fails leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.sources.versions import VersionedTable

# The known asset types and timeframes.
ASSET_TYPES = ("index", "stock", "volatility", "options")
TIMEFRAMES = ("1min", "3min", "5min", "15min", "60min", "daily")

BAR_SCHEMA = (
    "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long, "
    "asset_type string, timeframe string, year int"
)
ACTION_SCHEMA = (
    "symbol string, ex_date date, action_type string, ratio double, description string, verified string, source string"
)


def _known(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}; expected one of {', '.join(allowed)}")
    return value


def with_ts(raw: DataFrame) -> DataFrame:
    """Lower-case the columns and name the time column ``ts``."""
    df = raw.toDF(*[c.lower() for c in raw.columns])
    for candidate in ("datetime", "date", "ts"):
        if candidate in df.columns:
            return df.withColumnRenamed(candidate, "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    raise ValueError("no time column among datetime, date, ts")


def load_bars(
    spark: SparkSession,
    root: str,
    symbol: str | None = None,
    asset_type: str = "stock",
    timeframe: str = "daily",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Bars of one asset type and timeframe, inclusive of both dates.

    The asset type, timeframe and years prune folders before any is listed;
    symbol and time reach the Parquet reader as pushed filters. Options only
    exist as daily bars.
    """
    _known(asset_type, ASSET_TYPES, "asset type")
    _known(timeframe, TIMEFRAMES, "timeframe")
    frame = "daily" if asset_type == "options" else timeframe
    low, high = int(start[:4]) if start else None, int(end[:4]) if end else None

    def wanted(values: dict[str, str]) -> bool:
        year = values["year"]
        inside = not year.isdigit() or (low is None or low <= int(year)) and (high is None or int(year) <= high)
        return values["asset_type"] == asset_type and values["timeframe"] == frame and inside

    df = bar_table(spark, root).read(BAR_SCHEMA, wanted)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return df.select("symbol", "ts", "open", "high", "low", "close", "volume")


def bar_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, ("asset_type", "timeframe", "year"))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """All bars with their asset type, timeframe and year."""
    return bar_table(spark, root).read(BAR_SCHEMA)


def scan_files(spark: SparkSession, paths: list[str], symbol_pattern: str = r"/([^/]+)/[^/]+\.parquet$") -> DataFrame:
    """Scan per-symbol files; the symbol comes from each row's file path."""
    if not paths:
        raise FileNotFoundError("no bar files for this universe")
    path = F.url_decode(F.col("_metadata.file_path"))
    files = spark.read.parquet(*paths)
    rest = [c for c in files.columns if c != "symbol"]
    return files.select(F.regexp_extract(path, symbol_pattern, 1).alias("symbol"), *rest)


def existing_paths(spark: SparkSession, root: str, symbols: list[str], name: str) -> tuple[list[str], list[str]]:
    """Split the per-symbol paths into those that exist and the symbols without one."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found, missing = [], []
    for s in symbols:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{s}/{name}")
        if p.getFileSystem(conf).exists(p):
            found.append(p.toString())
        else:
            missing.append(s)
    return found, missing


def scan_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep the bars of the universe; the universe is joined, never listed into the plan."""
    return bars.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def scan_minutes(bars: DataFrame, from_date: str, session_open: str, session_end: str) -> DataFrame:
    """Bars from a date on whose time of day lies in the session.

    The date bound reaches the scan; the time-of-day bound is a residual filter.
    """
    from barlab.functions.scalars import minutes, to_minutes

    return bars.where(
        (F.col("ts") >= F.lit(from_date).cast("timestamp_ntz"))
        & minutes(F.col("ts")).between(to_minutes(session_open), to_minutes(session_end))
    )


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(
        path, header=True, comment="#",
        schema="date date, event_type string, description string, impact_level string",
    )
    return df.na.fill("", ["event_type", "description", "impact_level"])


def read_holidays_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, comment="#", schema="date date, holiday_name string").na.fill("")


def read_corp_actions(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """The ex-date registry; a typed empty frame when the file is missing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], ACTION_SCHEMA)
    df = spark.read.csv(path, header=True, comment="#", schema=ACTION_SCHEMA)
    df = df.withColumn("symbol", F.upper("symbol"))
    return df if symbol is None else df.where(F.col("symbol") == symbol.upper())


def read_corp_actions_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "symbol string, date date, ratio double, prev_close double, open double, close double"
    return spark.read.json(path, schema=schema, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per symbol of the universe manifest."""
    df = spark.read.json(path, schema="symbols array<string>, excluded_indices array<string>", multiLine=True)
    return df.select(F.explode("symbols").alias("symbol"))


RS_SCHEMA = "symbol string, ts timestamp_ntz, membership_type string, rs_value double, timeframe string, benchmark_index string"


def rs_table(spark: SparkSession, root: str) -> VersionedTable:
    return VersionedTable(spark, root, ("timeframe", "benchmark_index"))


def read_rs(spark: SparkSession, root: str, timeframe: str | None = None) -> DataFrame:
    return rs_table(spark, root).read(RS_SCHEMA, lambda values: timeframe is None or values["timeframe"] == timeframe)


def list_available(bars: DataFrame, asset_type: str | None = None) -> DataFrame:
    """Timeframes on hand per asset type and symbol."""
    df = bars if asset_type is None else bars.where(F.col("asset_type") == asset_type)
    return df.groupBy("asset_type", "symbol").agg(F.sort_array(F.collect_set("timeframe")).alias("timeframes"))


def bars_inventory(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, first and last time and the day span per key."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.datediff(F.max("ts"), F.min("ts")).alias("span_days"),
    )


def latest_bar_date(bars: DataFrame) -> DataFrame:
    """Last day on hand per symbol and the next day to fetch."""
    last = F.max(F.col("ts").cast("date"))
    return bars.groupBy("symbol").agg(last.alias("last_date"), F.date_add(last, 1).alias("next_date"))


def describe_groups(df: DataFrame, key: str, top: int) -> DataFrame:
    """Row counts of the largest groups of ``key``, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(top)


def describe_columns(df: DataFrame) -> DataFrame:
    """Non-null count of every column as rows."""
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return one.unpivot([], one.columns, "column_name", "non_null")


# sinks


def _laid_out(bars: DataFrame) -> DataFrame:
    out = bars.select("symbol", "ts", "open", "high", "low", "close", "volume").withColumn("year", F.year("ts"))
    return out.repartitionByRange("year", "symbol", "ts").sortWithinPartitions("year", "symbol", "ts")


def write_bars(bars: DataFrame, root: str, asset_type: str, timeframe: str) -> None:
    """Replace one asset type and timeframe as a whole: years that ``bars`` lacks are gone afterwards."""
    _replace(bars, root, asset_type, timeframe, touched_only=False)


def write_years(bars: DataFrame, root: str, asset_type: str, timeframe: str) -> None:
    """Replace only the years of one asset type and timeframe that ``bars`` has."""
    _replace(bars, root, asset_type, timeframe, touched_only=True)


def _replace(bars: DataFrame, root: str, asset_type: str, timeframe: str, touched_only: bool) -> None:
    fixed = {"asset_type": _known(asset_type, ASSET_TYPES, "asset type"), "timeframe": _known(timeframe, TIMEFRAMES, "timeframe")}
    bar_table(bars.sparkSession, root).replace(_laid_out(bars), fixed, touched_only)


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").parquet(path)


def write_rs(rs: DataFrame, root: str) -> None:
    """Replace every timeframe in ``rs`` as a whole: its benchmarks that ``rs`` lacks are gone afterwards."""
    columns = ["symbol", "ts", "membership_type", "rs_value", "benchmark_index"]
    table = rs_table(rs.sparkSession, root)
    for (timeframe,) in rs.select("timeframe").distinct().collect():  # at most as many as there are timeframes
        rows = rs.where(F.col("timeframe") == timeframe).select(*columns).repartitionByRange("benchmark_index", "symbol", "ts")
        table.replace(rows, {"timeframe": timeframe})


def write_csv(summary: DataFrame, path: str) -> None:
    """A table as CSV files with a header, written by as many tasks as it has partitions."""
    summary.write.mode("overwrite").csv(path, header=True)


def upsert_bars(existing: DataFrame, incoming: DataFrame, keys: list[str], incoming_wins: bool = True) -> DataFrame:
    """Union with one row per key; the incoming row wins, or the existing one on backfill.

    Keys are nearly unique, so one exchange and one sort by key is cheaper
    than an aggregate that would sort on both sides of the exchange.
    """
    columns = existing.columns
    both = existing.withColumn("_rank", F.lit(0)).unionByName(
        incoming.select(*columns).withColumn("_rank", F.lit(1 if incoming_wins else -1))
    )
    # equal rank falls to the largest row, so the pick does not depend on input order
    order = [F.desc("_rank"), *[F.desc(c) for c in columns if c not in keys]]
    return keep_latest(both, keys, order).select(*columns)


def merge_unique(existing: DataFrame, incoming: DataFrame, keys: list[str], incoming_wins: bool = True) -> DataFrame:
    """The same for two sides that are unique by key already.

    An anti-join instead of a sort: a small side is broadcast once its size
    is known, and the large side is not exchanged at all.
    """
    first, second = (incoming, existing) if incoming_wins else (existing, incoming)
    rest = second.select(*existing.columns).join(first.select(*keys), keys, "left_anti")
    return first.select(*existing.columns).unionByName(rest)


def upsert_table(spark: SparkSession, root: str, incoming: DataFrame, asset_type: str, timeframe: str,
                 incoming_wins: bool = True) -> None:
    """Upsert into the stored bars, rewriting only the years that ``incoming`` touches."""
    years = {str(r[0]) for r in incoming.select(F.year("ts").alias("y")).distinct().collect()}  # a row a year

    def touched(values: dict[str, str]) -> bool:
        return values["asset_type"] == asset_type and values["timeframe"] == timeframe and values["year"] in years

    columns = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    stored = bar_table(spark, root).read(BAR_SCHEMA, touched).select(*columns)
    # the folders being read stay until the new ones are named
    write_years(upsert_bars(stored, incoming.select(*columns), ["symbol", "ts"], incoming_wins), root, asset_type, timeframe)


def date_chunks(ranges: DataFrame, start: str, end: str, max_days: int) -> DataFrame:
    """Cut inclusive [start, end] ranges into consecutive chunks of at most ``max_days`` days."""
    if max_days < 1:
        raise ValueError("max_days must be at least 1")
    first = F.explode(F.sequence(F.col(start), F.col(end), F.make_dt_interval(days=F.lit(max_days))))
    kept = ranges.select("*", first.alias("chunk_start"))
    return kept.withColumn(
        "chunk_end", F.least(F.date_add(F.col("chunk_start").cast("date"), max_days - 1), F.col(end))
    ).withColumn("chunk_start", F.col("chunk_start").cast("date"))


def last_bar_per(bars: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    return bars.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
