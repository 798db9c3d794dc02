"""Tables laid out by key, so that windows, aggregates and joins by that key need no exchange.

A table that several steps of one query bring together by the same key is
written once, in buckets of that key and sorted within them; each later step
reads it where it lies. One day of one symbol is the key for bars, so a bucket
holds whole days and no symbol is bound to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame

from barlab.session import new_path

ROWS_A_BUCKET = 1_000_000
LEAST_BUCKETS = 8


def buckets_for(rows: int, rows_a_bucket: int = ROWS_A_BUCKET) -> int:
    """How many buckets a table of ``rows`` rows needs; grows with the table."""
    return max(LEAST_BUCKETS, -(-rows // rows_a_bucket))


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int, label: str = "bars") -> DataFrame:
    """``df`` written to the shared folder in ``buckets`` files by ``keys``, sorted by ``keys`` and ``order``.

    The rows are exchanged by the keys before the write, so each bucket is one
    file and its order holds. Only the session's catalog knows the table; its
    files are in the shared folder and outlive lost executors. An empty table
    stays empty and null keys share a bucket.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid4().hex}"
    (
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, *order)
        .option("path", new_path(spark, f"{label}-by-key")).saveAsTable(name, format="parquet")
    )
    return spark.table(name)
