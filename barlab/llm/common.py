"""What several operators share: reading a table, whole texts, words, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """All words of a text in order (maximal runs without ASCII white space, fixed by the contract of the queries), none for a text of white space. Splits at a plain space, which needs no regular expression."""
    return F.array_remove(F.split(_spaced(text), " "), "")


def word_hashes(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    return F.array_remove(F.array_distinct(F.transform(F.split(_spaced(text), " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _spaced(text: Column) -> Column:
    """White space of any kind as spaces."""
    for sign in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return text


def md5_number(text: Column, digits: int = 8) -> Column:
    """A repeatable number from a text, the same in other SQL engines; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    return materialise(df, f"llm-{label}")
