"""Running values over keys of any size: a segmented scan by ranges with carried states.

A plain window gives one task a whole key. Here each key is cut into ranges of
its order. A range is scanned by itself, its state is what its last row has,
the states of the ranges ahead (a few dozen a key) are combined into what each
range starts from, and that is combined with the rows. Any operation that can
be combined so will do: sums, extremes, the last known value, the row before.
Scans over the results of scans give run lengths and drawdowns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.ordering import PARTS, _attach, with_ranges
from barlab.session import materialise

OPERATIONS = ("sum", "max", "min", "last", "previous")


def as_number(df: DataFrame, column: str) -> Column:
    """A number, date or time column as a number that orders alike."""
    kind = dict(df.dtypes)[column]
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if kind == "timestamp":
        return F.unix_micros(column).cast("double")
    if kind in ("string", "binary", "boolean") or kind.startswith(("array", "map", "struct")):
        raise ValueError(f"{column} is a {kind}; ranges need a number, a date or a time")
    return F.col(column).cast("double")


class Scan:
    """Rows cut into ranges of one order, to which running columns can be added one after the other.

    ``order`` places the rows of a key in time or by value; ``ties`` order rows
    of equal place, and must make the order unique for repeatable results.
    Equal places are never cut apart. The rows are written once with their
    ranges: a sketch need not give the same cuts twice, and the states and the
    rows must see the same ones.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Column, ties: Sequence[Column | str] = (), parts: int = PARTS) -> None:
        self.keys = list(keys)
        self.inside = [F.col("_v").asc_nulls_first(), *ties]
        self.rows = materialise(with_ranges(df, self.keys, order, parts), "ranges")

    def add(self, **columns: tuple[str, Column]) -> Scan:
        """Add running columns, each an operation of OPERATIONS and what it runs over."""
        part = [*self.keys, "_part"]
        rising = Window.partitionBy(*part).orderBy(*self.inside)
        upto = rising.rowsBetween(Window.unboundedPreceding, 0)
        own = {"_rn": F.row_number().over(rising)}
        for name, (kind, value) in columns.items():
            if kind not in OPERATIONS:
                raise ValueError(f"unknown operation {kind!r}; expected one of {', '.join(OPERATIONS)}")
            own[f"_x_{name}"] = value
        scanned = self.rows.withColumns(own)
        scanned = scanned.withColumns({f"_w_{n}": self._inside(kind, F.col(f"_x_{n}"), rising, upto) for n, (kind, _) in columns.items()})
        states = scanned.groupBy(*part).agg(
            *[F.max_by(f"_x_{n}" if kind == "previous" else f"_w_{n}", "_rn").alias(f"_s_{n}") for n, (kind, _) in columns.items()]
        )
        ahead = Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy("_part")
        carried = states.select(*part, *[self._carried(kind, F.col(f"_s_{n}"), ahead).alias(f"_c_{n}") for n, (kind, _) in columns.items()])
        out = _attach(scanned, carried, part)
        out = out.withColumns({n: self._combined(kind, n) for n, (kind, _) in columns.items()})
        self.rows = out.drop("_rn", *[f"_{c}_{n}" for n in columns for c in "xwc"])
        return self

    def result(self) -> DataFrame:
        return self.rows.drop("_v", "_part")

    @staticmethod
    def _inside(kind: str, value: Column, rising, upto) -> Column:
        if kind == "previous":
            return F.lag(value).over(rising)
        if kind == "last":
            return F.last(value, ignorenulls=True).over(upto)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(upto)

    @staticmethod
    def _carried(kind: str, state: Column, ahead) -> Column:
        earlier = ahead.rowsBetween(Window.unboundedPreceding, -1)
        if kind == "previous":
            return F.lag(state).over(ahead)
        if kind == "last":
            return F.last(state, ignorenulls=True).over(earlier)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](state).over(earlier)

    @staticmethod
    def _combined(kind: str, name: str) -> Column:
        own, carried = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(own + carried, own, carried)
        if kind == "previous":
            return F.when(F.col("_rn") == 1, carried).otherwise(own)
        if kind == "last":
            return F.coalesce(own, carried)
        return F.greatest(own, carried) if kind == "max" else F.least(own, carried)
