"""A replace that dies leaves the old table, and its folders are never read."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barlab.sources import bars as B
from barlab.sources.versions import ConcurrentWrite, VersionedTable

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars(spark, years, close=1.5):
    return spark.createDataFrame([("A", dt.datetime(y, 3, 1), 1.0, 2.0, 0.5, close, 10) for y in years], SCHEMA)


def held(spark, root, timeframe="daily"):
    return sorted((r.ts.year, r.close) for r in B.load_bars(spark, root, timeframe=timeframe).collect())


def folders(root):
    return sorted(os.path.relpath(at, root) for at, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files))


@pytest.fixture
def root(spark, tmp_path):
    at = str(tmp_path / "bars")
    B.write_bars(bars(spark, [2020, 2021]), at, "stock", "daily")
    B.write_bars(bars(spark, [2021], 9.0), at, "stock", "60min")
    return at


def failing(spark, years):
    """Bars whose later rows fail while they are written, after files of the first are there."""
    boom = F.when(F.year("ts") == max(years), F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("close"))
    return bars(spark, years, 7.0).withColumn("close", boom)


@pytest.mark.parametrize("write", [B.write_bars, B.write_years])
def test_a_write_that_dies_changes_nothing(spark, root, write):
    before = folders(root)
    with pytest.raises(Exception, match="killed"):
        write(failing(spark, [2020, 2022]), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 1.5)]
    assert set(before) <= set(folders(root))


def test_a_death_before_the_switch_changes_nothing(spark, root, monkeypatch):
    def dies(self, number, names):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTable, "_switch", dies)
        with pytest.raises(KeyboardInterrupt):
            B.write_bars(bars(spark, [2020], 7.0), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 1.5)]
    assert len(folders(root)) == 4  # the unnamed folder is there, and not read
    B.write_years(bars(spark, [2021], 3.0), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 3.0)]
    B.bar_table(spark, root).vacuum()
    assert held(spark, root) == [(2020, 1.5), (2021, 3.0)]
    assert len(folders(root)) == 3


def test_a_death_after_the_switch_keeps_the_new_table(spark, root, monkeypatch):
    def dies(self, names):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(VersionedTable, "_delete", dies)
        with pytest.raises(KeyboardInterrupt):
            B.write_bars(bars(spark, [2022], 7.0), root, "stock", "daily")
    assert held(spark, root) == [(2022, 7.0)]
    assert held(spark, root, "60min") == [(2021, 9.0)]
    B.bar_table(spark, root).vacuum()
    assert len(folders(root)) == 2
    assert held(spark, root) == [(2022, 7.0)]


def test_a_torn_manifest_is_not_read(spark, root):
    table = B.bar_table(spark, root)
    number, _ = table.current()
    with open(f"{root}/_manifest/{number + 1:012d}.json", "w") as out:
        out.write('{"folders": ["asset_type=st')
    assert table.current()[0] == number
    assert held(spark, root) == [(2020, 1.5), (2021, 1.5)]
    B.write_years(bars(spark, [2021], 2.0), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 2.0)]


def test_of_two_writers_from_one_manifest_one_fails(spark, root):
    table = B.bar_table(spark, root)
    number, names = table.current()
    table._switch(number + 1, names)
    with pytest.raises(ConcurrentWrite):
        table._switch(number + 1, [])
    assert held(spark, root) == [(2020, 1.5), (2021, 1.5)]


def test_the_writer_that_loses_drops_its_folders_only(spark, root, monkeypatch):
    before = VersionedTable._write

    def meanwhile(df, path, by):
        before(df, path, by)
        with monkeypatch.context() as patched:
            patched.setattr(VersionedTable, "_write", staticmethod(before))
            B.write_years(bars(spark, [2021], 6.0), root, "stock", "daily")

    monkeypatch.setattr(VersionedTable, "_write", staticmethod(meanwhile))
    with pytest.raises(ConcurrentWrite):
        B.write_bars(bars(spark, [2020, 2021], 7.0), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 6.0)]
    assert len(folders(root)) == 3


def test_a_tree_without_a_manifest_is_taken_over(spark, tmp_path):
    root = str(tmp_path / "plain")
    plain = bars(spark, [2020, 2021]).withColumn("year", F.year("ts"))
    plain.write.partitionBy("year").parquet(f"{root}/asset_type=stock/timeframe=daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 1.5)]
    B.write_years(bars(spark, [2021], 4.0), root, "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 4.0)]
    B.write_bars(bars(spark, [2021], 5.0), root, "stock", "daily")
    assert held(spark, root) == [(2021, 5.0)]
    assert len(folders(root)) == 1


def test_an_upsert_reads_what_it_replaces(spark, root):
    B.upsert_table(spark, root, bars(spark, [2021, 2023], 8.0), "stock", "daily")
    assert held(spark, root) == [(2020, 1.5), (2021, 8.0), (2023, 8.0)]


def test_folders_are_pruned_before_listing(spark, root):
    got = B.load_bars(spark, root, start="2021-01-01", end="2021-12-31")
    assert [r.ts.year for r in got.collect()] == [2021]
    assert all("year=2021" in f and "timeframe=daily" in f for f in got.inputFiles())
    assert B.load_bars(spark, root, asset_type="index").count() == 0
