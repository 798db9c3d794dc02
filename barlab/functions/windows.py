"""Row-frame helpers: windows that end today, windows that end yesterday.

All of them work on one row per key and date (or bar), so a frame never holds
more rows than its length, and several of them over the same key and order
share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str | list[str] = "symbol", order: str | list[str] = "date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*orders)


def one_series(order: str) -> WindowSpec:
    """Order without a key, for tables that hold one row per calendar day."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def roll(fn: Callable[[Column], Column], x: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    """``fn`` over the ``n`` rows ending now, null below ``min_rows`` non-null values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= min_rows, fn(x).over(frame))


def trail(fn: Callable[[Column], Column], x: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    """``fn`` over the ``n`` rows before now."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= min_rows, fn(x).over(frame))


def trailing_zscore(x: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    mean = trail(F.avg, x, n, min_rows, w)
    std = trail(F.stddev_samp, x, n, min_rows, w)
    return (x - mean) / nonzero(std)


def nonzero(x: Column) -> Column:
    """Zero becomes null, so a ratio is null instead of infinite."""
    return F.when(x != 0, x)


def ratio(a: Column, b: Column) -> Column:
    return a / nonzero(b)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / nonzero(F.stddev_pop(x) * F.stddev_pop(y))


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    return ratio(x, F.lag(x, n).over(w)) - 1


def rolling_corr(x: Column, y: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    """Correlation from rolling moments: population covariance, sample deviations.

    Each moment counts its own non-null rows; this differs from ``corr`` by
    the factor (n-1)/n on purpose.
    """
    cov = rolling_cov(x, y, n, min_rows, w)
    return cov / nonzero(roll(F.stddev_samp, x, n, min_rows, w) * roll(F.stddev_samp, y, n, min_rows, w))


def rolling_cov(x: Column, y: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    return roll(F.avg, x * y, n, min_rows, w) - roll(F.avg, x, n, min_rows, w) * roll(F.avg, y, n, min_rows, w)


def rolling_beta(x: Column, m: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    return rolling_cov(x, m, n, min_rows, w) / nonzero(roll(F.var_samp, m, n, min_rows, w))


def rolling_compound(r: Column, n: int, min_rows: int, w: WindowSpec) -> Column:
    """Compounded return over the frame, as the exponential of summed logs."""
    return F.exp(roll(F.sum, F.log1p(r), n, min_rows, w)) - 1


def running(fn: Callable[[Column], Column], x: Column, w: WindowSpec) -> Column:
    """``fn`` from the first row up to this one."""
    from pyspark.sql import Window as W

    return fn(x).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    from pyspark.sql import Window as W

    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))


def centred_extreme(fn: Callable[[Column], Column], x: Column, k: int, w: WindowSpec) -> Column:
    """``fn`` over the 2k+1 rows around this one, null unless all are there."""
    frame = w.rowsBetween(-k, k)
    return F.when(F.count(x).over(frame) == 2 * k + 1, fn(x).over(frame))


def strict_peak(x: Column, k: int, w: WindowSpec) -> Column:
    """True where ``x`` is above each of the ``k`` rows on both sides."""
    before, after = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
    full = (F.count(x).over(before) == k) & (F.count(x).over(after) == k)
    return F.coalesce(full & (x > F.max(x).over(before)) & (x > F.max(x).over(after)), F.lit(False))


def bar_number(w: WindowSpec) -> Column:
    """Zero-based position."""
    return F.row_number().over(w) - 1
