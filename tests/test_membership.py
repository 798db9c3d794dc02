"""Memberships of symbols in lists."""

from barlab.operators.strength import membership_map


def lists(spark):
    constituents = spark.createDataFrame([("IT", ["a", "b"]), ("BANK", ["b", "ghost"]), (None, ["a"]), ("BANK", ["b"])], "benchmark_index string, symbols array<string>")
    universe = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "symbol string")
    return membership_map(constituents, universe, "ALL")


def test_a_row_per_list_and_a_broad_one(spark):
    got = sorted((tuple(r[c] for c in ("symbol", "benchmark_index", "membership_type")) for r in lists(spark).collect()), key=str)
    want = [("a", "IT", "sector"), ("b", "IT", "sector"), ("b", "BANK", "sector"), ("b", "BANK", "sector"), ("a", None, "sector")]
    want += [(s, "ALL", "broad") for s in ("a", "b", "c", None)]
    assert got == sorted(want, key=str)


def test_no_union_of_parts_dealt_by_symbol(spark):
    """Such a union cannot be run where its parts end up with different numbers of partitions."""
    assert "Union" not in lists(spark)._jdf.queryExecution().optimizedPlan().toString()
