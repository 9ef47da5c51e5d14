"""Merging of several sources of the same data, with one deterministic winner per time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import repaired_ohlc
from tickloom.operators import dedupe


@dataclass(frozen=True)
class Source:
    name: str
    rows: DataFrame
    quality: float
    priority: int


def stacked(sources: list[Source]) -> DataFrame:
    tagged = [s.rows.withColumns({"_source": F.lit(s.name), "_quality": F.lit(s.quality), "_priority": F.lit(s.priority)})
              for s in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def compared(sources: list[Source], price_tol: float, volume_tol: float) -> DataFrame:
    """Every distinct trade beside the best-priority trade of its time, with differences.

    Groups shrink by aggregation first: copies of one fingerprint become one row, and the base of a
    time is a single row joined back, so no group of copies is ever gathered.
    """
    t = stacked(sources).withColumn("_print", dedupe.fingerprint())
    one = dedupe.keep(t, ["symbol", "_print"], ["_priority", "seq"], last=False)
    base = one.groupBy("symbol", "ts").agg(
        F.min_by(F.struct(F.col("price").alias("p"), F.col("quantity").alias("q"), F.col("_source").alias("s"), F.col("_priority").alias("r")),
                 F.struct("_priority", -F.col("_quality"), "seq")).alias("_base"))
    j = one.join(base, ["symbol", "ts"])
    dp = F.abs(F.col("_base.p") - F.col("price")) / F.col("_base.p")
    dq = F.abs(F.col("_base.q") - F.col("quantity")) / F.col("_base.q")
    return j.withColumns({"price_diff": dp, "volume_diff": dq, "conflict": (dp > price_tol) | (dq > volume_tol)})


def merge_trades(sources: list[Source], mode: str = "quality", price_tol: float = 0.001,
                 volume_tol: float = 0.01) -> DataFrame:
    """One trade per (symbol, ts).

    Within tolerance the best-priority trade stands.  Otherwise ``quality`` takes the highest
    quality, ``average`` the mean price and quantity, ``priority`` the base, ``latest`` the source
    merged last.
    """
    j = compared(sources, price_tol, volume_tol)
    pick = F.struct(F.col("price").alias("p"), F.col("quantity").cast("double").alias("q"))
    g = j.groupBy("symbol", "ts").agg(
        F.min_by(pick, F.struct("_priority", -F.col("_quality"), "seq")).alias("base"),
        F.max_by(pick, F.struct("_quality", -F.col("_priority"), -F.col("seq"))).alias("best"),
        F.max_by(pick, F.struct("_priority", "_quality", "seq")).alias("newest"),
        F.avg("price").alias("mp"), F.avg("quantity").alias("mq"), F.max("conflict").alias("conflict"))
    chosen = {"quality": F.col("best"), "priority": F.col("base"), "latest": F.col("newest"),
              "average": F.struct(F.col("mp").alias("p"), F.col("mq").alias("q"))}[mode]
    win = F.when(F.col("conflict"), chosen).otherwise(F.col("base"))
    return g.withColumn("_w", win).select("symbol", "ts", F.col("_w.p").alias("price"), F.col("_w.q").alias("quantity"),
                                          F.col("conflict").cast("int").alias("conflict"))


def conflict_report(sources: list[Source], price_tol: float = 0.001, volume_tol: float = 0.01) -> DataFrame:
    return compared(sources, price_tol, volume_tol).where("conflict").select(
        "symbol", "ts", F.col("_base.s").alias("source1"), F.col("_base.p").alias("value1"),
        F.col("_source").alias("source2"), F.col("price").alias("value2"), (F.col("price_diff") * 100).alias("diff_pct"))


def first_source(sources: list[Source], keys: list[str]) -> DataFrame:
    """Generic merge: the first source (by name) that has the key."""
    return dedupe.keep(stacked(sources), keys, ["_source", "seq"], last=False)


def merge_candles(sources: list[Source], weighted: bool = True) -> DataFrame:
    """Candles of one time from several sources: quality-weighted means, or the best priority."""
    s = stacked(sources)
    if weighted:
        w = F.col("_quality")
        mean = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(c)
        return s.groupBy("symbol", "ts").agg(*[mean(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))
    row = F.struct("open", "high", "low", "close", "volume")
    return s.groupBy("symbol", "ts").agg(F.min_by(row, F.struct("_priority", -F.col("_quality"))).alias("r")).select("symbol", "ts", "r.*")


def tidy_candles(bars: DataFrame) -> DataFrame:
    return bars.withColumns(repaired_ohlc())


def tidy_trades(trades: DataFrame) -> DataFrame:
    return trades.where(F.col("quantity") > 0)
