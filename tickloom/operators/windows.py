"""Small window helpers: minimum periods, rolling ranks, fills and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time(*keys: str, order: str = "ts") -> WindowSpec:
    """Plain ordered window for tables that the clock bounds per key (bars)."""
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def roll(fn: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, minimum: int | None = None) -> Column:
    """``fn(x)`` over the last n rows; null until ``minimum`` (default n) values are there."""
    frame = last_rows(w, n)
    return F.when(F.count(x).over(frame) >= (n if minimum is None else minimum), fn(x).over(frame))


def rmean(x, w, n, minimum=None):
    return roll(F.avg, x, w, n, minimum)


def rstd(x, w, n, minimum=None):
    return roll(F.stddev_samp, x, w, n, minimum)


def rsum(x, w, n, minimum=None):
    return roll(F.sum, x, w, n, minimum)


def rmax(x, w, n, minimum=None):
    return roll(F.max, x, w, n, minimum)


def rmin(x, w, n, minimum=None):
    return roll(F.min, x, w, n, minimum)


def rmedian(x, w, n, minimum=None):
    return roll(lambda c: F.percentile(c, 0.5), x, w, n, minimum)


def pct_change(x: Column, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(x, k).over(w)
    return F.try_divide(x, before) - 1


def percentile_rank(x: Column, w: WindowSpec, n: int) -> Column:
    """Average-rank percentile of the current value among the last n (ties share their rank).

    Every row looks at n values: for bars and short frames; ``sliding`` takes the logarithm of n.
    """
    frame = last_rows(w, n)
    seen = F.collect_list(x).over(frame)
    less = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return F.when(F.count(x).over(frame) >= n, (less + (equal + 1) / 2.0) / F.size(seen))


def distinct_in(x: Column, frame: WindowSpec) -> Column:
    """Distinct values of short frames; ``sliding`` counts those of long ones."""
    return F.size(F.collect_set(x).over(frame)).cast("long")


def trend_slope(y: Column, position: Column, frame: WindowSpec, n: int) -> Column:
    """Least-squares slope against the row position; needs n rows."""
    return F.when(F.count(y).over(frame) >= n, F.regr_slope(y, position).over(frame))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; stays null where x is null (``greatest``/``least`` alone would skip nulls)."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def corr(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation, as an aggregate or over a frame; null where a side is constant.

    The built-in divides by zero there, which is an error in ANSI mode.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    cov, sx, sy = [p.over(frame) if frame is not None else p for p in parts]
    return F.try_divide(cov, sx * sy)
