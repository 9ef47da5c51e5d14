"""Comparison of a clock window with the same window of earlier days.

Bars are put on a full time grid, so "the same hour k days ago" is a fixed number of rows back in
the symbol, or k rows back in (symbol, clock time), and needs no self join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.windows import corr, last_rows, rmean, rstd

#: Steps of a grid that one row is expanded to at once.
GRID_BLOCK = 1024


def grid(bars: DataFrame, minutes: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row for every step between the first and last bar of a key; ``real`` marks given bars.

    A key's span is cut into blocks of steps, which are spread before they are expanded, so a long
    grid of one key is no single task's work.
    """
    step = minutes * 60_000_000
    span = bars.groupBy(*keys).agg(F.unix_micros(F.min("ts")).alias("_a"), F.unix_micros(F.max("ts")).alias("_b"))
    span = span.withColumn("_n", F.floor((F.col("_b") - F.col("_a")) / step).cast("long"))
    blocks = span.select(*keys, "_a", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"), F.lit(GRID_BLOCK).cast("long"))).alias("_i")).repartition(*keys, "_i")
    steps = blocks.select(*keys, "_a", F.explode(F.sequence("_i", F.least(F.col("_i") + GRID_BLOCK - 1, F.col("_n")))).alias("_i"))
    all_ts = steps.select(*keys, F.timestamp_micros(F.col("_a") + F.col("_i") * step).alias("ts"))
    return all_ts.join(bars.withColumn("real", F.lit(1)), [*keys, "ts"], "left").withColumn("real", F.coalesce("real", F.lit(0)))


def dense(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """Grid with carried closes and zero volume in empty steps."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    g = grid(bars.select("symbol", "ts", "close", "volume"), minutes)
    return g.withColumns({"close": F.last("close", ignorenulls=True).over(w), "volume": F.coalesce("volume", F.lit(0))})


def _add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _share_below(g: DataFrame, col: str, days: int) -> Column:
    """Share of the values at the same clock time of up to ``days`` earlier days that lie below.

    On a full grid those are the preceding rows of (symbol, clock time).  Null without any.
    """
    w = Window.partitionBy("symbol", "_clock").orderBy("ts").rowsBetween(-days, -1)
    past = F.collect_list(col).over(w)
    x = F.col(col)
    return F.when(x.isNotNull() & (F.size(past) > 0), F.size(F.filter(past, lambda v: v < x)) / F.size(past))


def _clocked(g: DataFrame) -> DataFrame:
    return g.withColumn("_clock", F.unix_seconds("ts") % 86_400)


def volume_pattern(g: DataFrame, n: int, per_day: int, days: int = 7) -> DataFrame:
    """Mean correlation of the last n volumes with the same window of earlier days."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f = last_rows(w, n)
    for k in range(1, days + 1):
        g = g.withColumn(f"_p{k}", F.lag("volume", per_day * k).over(w))
    corrs = []
    for k in range(1, days + 1):
        past = F.col(f"_p{k}")
        ok = (F.count(past).over(f) >= n) & (F.stddev_pop("volume").over(f) > 0) & (F.stddev_pop(past).over(f) > 0)
        g = g.withColumn(f"_c{k}", F.when(ok, corr(F.col("volume"), past, f)))
        corrs.append(F.col(f"_c{k}"))
    seen = _add([c.isNotNull().cast("int") for c in corrs])
    total = _add([F.coalesce(c, F.lit(0.0)) for c in corrs])
    return g.withColumn("volume_pattern", F.when(seen > 0, total / seen).otherwise(0.5)).drop(
        *[f"_{a}{k}" for a in "pc" for k in range(1, days + 1)])


def momentum_rank(g: DataFrame, n: int, days: int = 30) -> DataFrame:
    """Share of earlier days whose move over the same window was smaller."""
    w = Window.partitionBy("symbol").orderBy("ts")
    g = g.withColumn("_m", F.round((F.col("close") / F.lag("close", n).over(w) - 1) * 100, 9))
    share = _share_below(g, "_m", days)
    return _clocked(g).withColumn("momentum_rank", F.coalesce(share, F.lit(0.5))).drop("_m", "_clock")


def momentum_percentile(g: DataFrame, periods: list[int], days: int = 14) -> DataFrame:
    """Mean over several periods of the share of earlier days with a smaller move."""
    w = Window.partitionBy("symbol").orderBy("ts")
    for n in periods:
        g = g.withColumn(f"_m{n}", F.round((F.col("close") / F.lag("close", n).over(w) - 1) * 100, 9))
    g = _clocked(g)
    g = g.withColumns({f"_s{n}": _share_below(g, f"_m{n}", days) for n in periods})
    seen = _add([F.col(f"_s{n}").isNotNull().cast("int") for n in periods])
    total = _add([F.coalesce(f"_s{n}", F.lit(0.0)) for n in periods])
    return g.withColumn("momentum_percentile", F.when(seen > 0, total / seen).otherwise(0.5)).drop(
        "_clock", *[f"_{a}{n}" for a in "ms" for n in periods])


def volatility_regime(g: DataFrame, per_day: int, days: int = 30) -> DataFrame:
    """Volatility of the last day ranked against the same measure on earlier days."""
    w = Window.partitionBy("symbol").orderBy("ts")
    g = g.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    g = g.withColumn("volatility", F.round(rstd(F.col("_r"), w, per_day), 12))
    g = _clocked(g)
    g = g.withColumn("_p", _share_below(g, "volatility", days))
    q = F.col("_p")
    return g.withColumns({
        "volatility_percentile": F.coalesce(q, F.lit(0.5)),
        "volatility_regime": F.when(q.isNull(), "UNKNOWN").when(q > 0.8, "HIGH_VOL").when(q < 0.2, "LOW_VOL").otherwise("NORMAL_VOL"),
    }).drop("_r", "_p", "_clock")


def coverage(g: DataFrame, n: int) -> DataFrame:
    """Share of the last n steps that hold real data, and how much of the look-back exists."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f = last_rows(w, n)
    return g.withColumns({"data_quality": F.avg("real").over(f), "lookback_coverage": F.least(
        F.row_number().over(w) / F.lit(float(n)), F.lit(1.0))})


def enhanced(bars: DataFrame, minutes: int = 60, n: int = 6) -> DataFrame:
    """All history features of every real bar, from one grid."""
    per_day = 24 * 60 // minutes
    g = dense(bars, minutes)
    g = volume_pattern(g, n, per_day)
    g = momentum_rank(g, n)
    g = momentum_percentile(g, [1, 3, n])
    g = volatility_regime(g, per_day)
    return coverage(g, per_day).where("real = 1")
