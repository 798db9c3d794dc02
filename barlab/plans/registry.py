"""Named queries with one column list that shapes both the Spark and the SQL result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.plans.sql_base import with_tables
from barlab.sources.fixtures import Fixtures

# Kinds in a column list: s text, d date, t timestamp, i integer, b boolean,
# r double rounded to 6 places, r<n> double rounded to n places, p price: a
# two-digit amount over a quantity up to 50, which never ties at 7 places.


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    columns: list[tuple[str, str]]
    sql: str | None
    settings: dict[str, str]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return _shape(self.build(Fixtures(spark, folder)), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        picked = ", ".join(_sql_cast(n, k) for n, k in self.columns)
        return with_tables(f"SELECT {picked} FROM ({self.sql}) AS result")


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a builder; ``columns`` is text such as ``"symbol date:d close:r"``."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        parsed = [tuple((c + ":s").split(":")[:2]) for c in columns.split()]
        QUERIES[name] = Query(name, build, parsed, sql, {})
        return build

    return register


def _places(kind: str) -> int:
    return 7 if kind == "p" else int(kind[1:] or 6)


def _shape(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind[0] in "rp":
            c = F.round(c.cast("double"), _places(kind))
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_cast(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "d":
        expr = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        expr = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    elif kind == "i":
        expr = f"CAST({q} AS BIGINT)"
    elif kind == "b":
        expr = f"CAST({q} AS BOOLEAN)"
    elif kind[0] in "rp":
        expr = f"round(CAST({q} AS DOUBLE), {_places(kind)}) + 0.0"
    else:
        expr = f"CAST({q} AS VARCHAR)"
    return f"{expr} AS {q}"
