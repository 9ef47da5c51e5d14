"""As-of joins, recent-interval sums, alignment and lookup joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import Ordered, lay_out, time_values
from tickloom.session import small_side


def _stacked(left: DataFrame, right: DataFrame, keys: list[str], ts: str, seq: str,
             chunk_rows: int | None) -> Ordered:
    """Both sides in one time order per key; at equal times right rows come first."""
    one = lambda df, rank, mine, other, width: df.select(
        *keys, F.col(ts), F.lit(rank).alias("_side"), F.col(seq).alias("_tie"),
        F.struct(*df.columns).alias(mine), F.lit(None).cast(width.schema.simpleString()).alias(other))
    rows = one(right, 0, "_r", "_l", left).unionByName(one(left, 1, "_l", "_r", right))
    return lay_out(rows, keys, [ts, "_side", "_tie"], chunk_rows)


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts",
         seq: str = "seq", direction: str = "backward", tolerance: float | None = None,
         prefix: str = "r_", chunk_rows: int | None = None) -> DataFrame:
    """Left rows with the right row of the nearest time; no pair is ever generated.

    ``backward`` takes the latest right row at or before the left time (the last one on a tie);
    ``nearest`` the closer of both directions, backward on equal gaps.  Beyond ``tolerance``
    seconds the right values are null.
    """
    o = _stacked(left, right, keys, ts, seq, chunk_rows)
    spec = {"_p": ("last", F.col("_r"))}
    if direction == "nearest":
        spec["_n"] = ("next", F.col("_r"))
    out = o.running(o.chunked(), **spec).where("_side = 1")
    us = F.unix_micros(ts)
    if direction == "nearest":
        back, ahead = us - F.unix_micros(F.col(f"_p.{ts}")), F.unix_micros(F.col(f"_n.{ts}")) - us
        hit = F.when(F.col("_n").isNull() | (back <= ahead), F.col("_p")).otherwise(F.col("_n"))
    else:
        hit = F.col("_p")
    out = out.withColumn("_hit", hit)
    gap = F.abs(us - F.unix_micros(F.col(f"_hit.{ts}"))) / 1e6
    ok = F.lit(True) if tolerance is None else gap <= tolerance
    return out.select("_l.*", F.when(ok, gap).alias(f"{prefix}gap"), *[
        F.when(ok, F.col(f"_hit.{c}")).alias(prefix + c) for c in values])


def recent(left: DataFrame, right: DataFrame, keys: list[str], seconds: float, sums: dict[str, Column],
           ts: str = "ts", chunk_rows: int | None = None) -> DataFrame:
    """Sums over the right rows in the ``seconds`` up to each left row (range join without pairs)."""
    spec = {n: ("sum", v, seconds) for n, v in sums.items()}
    out = time_values(right, keys, ts, spec, extra=left, chunk_rows=chunk_rows)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})


def near_marked(df: DataFrame, keys: list[str], order: list[str], marked: Column, half: int,
                chunk_rows: int | None = None) -> DataFrame:
    """Rows at most ``half`` positions from a marked row, once each."""
    o = lay_out(df, keys, order, chunk_rows)
    rows = o.chunked(half, half).withColumn("_m", F.max(marked.cast("int")).over(o.frame(-half, half)))
    return o.finish(rows.where("_m = 1")).drop("_m")


def align_inner(tables: list[DataFrame], keys: list[str], tail: int) -> DataFrame:
    """Rows whose key exists in all tables, complete, and the latest ``tail`` per first key."""
    joined = reduce(lambda a, b: a.join(b, keys, "inner"), tables).na.drop()
    w = Window.partitionBy(keys[0]).orderBy(*[F.desc(k) for k in keys[1:]])
    return joined.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= tail).drop("_r")


def join_filled(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], how: str,
                zero: bool) -> DataFrame:
    """Left or full join on key and time with forward fill of the right values (bar tables)."""
    w = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)
    out = left.join(right, keys, how)
    fill = lambda c: F.last(c, ignorenulls=True).over(w)
    return out.withColumns({c: F.coalesce(fill(c), F.lit(0)) if zero else fill(c) for c in values})


def inner_or_full(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Inner join; when the keys are disjoint, full join with forward fill."""
    if left.join(right, keys, "left_semi").isEmpty():
        return join_filled(left, right, keys, values, "full", zero=False)
    return left.join(right, keys, "inner")


def full_outer(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full join of several tables; value columns carry the table's name as prefix."""
    named = [df.select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c not in keys])
             for n, df in tables.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), named)


def attach_flow(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bid/ask imbalance of each (key, bucket) group on every row: aggregate, then join."""
    bid = F.sum(F.when(F.col("side") == "bid", F.col("quantity")).otherwise(0))
    ask = F.sum(F.when(F.col("side") == "ask", F.col("quantity")).otherwise(0))
    mb = F.coalesce(F.avg(F.when(F.col("side") == "bid", F.col("quantity"))), F.lit(0.0))
    ma = F.coalesce(F.avg(F.when(F.col("side") == "ask", F.col("quantity"))), F.lit(0.0))
    per = df.groupBy(*keys).agg(
        ((bid - ask) / (bid + ask)).alias("imbalance"), (bid / (bid + ask)).alias("bid_ratio"),
        ((mb - ma) / (mb + ma + 1)).alias("size_imbalance"), F.count(F.lit(1)).alias("updates"))
    return df.join(per, keys)


def flag_members(df: DataFrame, col: str, members: DataFrame, name: str) -> DataFrame:
    """1 where the value belongs to ``members``, a reference set whose size is checked."""
    ref = small_side(members.select(F.col(col).alias("_m")).withColumn("_in", F.lit(1)))
    return df.join(ref, F.col(col) == F.col("_m"), "left").withColumn(
        name, F.coalesce("_in", F.lit(0))).drop("_m", "_in")
