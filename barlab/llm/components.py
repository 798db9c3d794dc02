"""Connected components of links between numbered nodes, by alternating stars over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import staged

_MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of the links ``a``, ``b``.

    Each round hangs all larger neighbours of a node below its smallest one,
    then all smaller ones; stars are left when nothing changes. A node's
    neighbours are only ever aggregated to a minimum, so hubs are harmless.
    Null ends and loops are left out; no links give an empty table.
    """
    tree = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    tree = staged(tree, "links")
    before = None
    for _ in range(_MOST_ROUNDS):
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        tree = staged(small.distinct(), "stars")
        now = tuple(tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError("components did not settle")
