"""Ordered row-frame and cumulative operators over large tick tables (chunked, see ``ordered``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import windows as wn
from tickloom.operators.ordered import HELPERS, Ordered, exact_quantiles, lay_out, time_values
from tickloom.operators.sliding import add_sliding
from tickloom.session import small_side

KEYS, ORDER = ["symbol"], ["ts", "seq"]


def layout(df: DataFrame, chunk_rows: int | None = None) -> Ordered:
    return lay_out(df, KEYS, ORDER, chunk_rows)


def rolling_stats(df: DataFrame, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Moments, extremes, median and rank of the last n rows; null until n prices are there."""
    o = layout(df, chunk_rows)
    w, p = o.window, F.col("price")
    rows = o.chunked(before=n - 1).select(
        "symbol", "seq", "price", *HELPERS, wn.rmean(p, w, n).alias("mean"), wn.rstd(p, w, n).alias("std"),
        wn.rmin(p, w, n).alias("min"), wn.rmax(p, w, n).alias("max"), wn.rsum(p, w, n).alias("sum"),
        F.when(F.count(p).over(o.last(n)) >= n, wn.corr(p, F.col("quantity"), o.last(n))).alias("corr"),
        wn.roll(F.var_pop, p, w, n).alias("turbulence"))
    return order_stats(o, rows, "price", n).drop("price")


def order_stats(o: Ordered, rows: DataFrame, col: str, n: int) -> DataFrame:
    """Median and rank of ``col`` over the last n rows, logarithmic in n; needs n - 1 rows before each chunk."""
    return o.finish(add_sliding(rows, {"median": ("median", col, 1 - n, 0, n), "rank": ("rank", col, 1 - n, 0, n)}))


def rolling_agents(df: DataFrame, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Distinct agents (frame with the current row) and concentration (frame before it), logarithmic in n."""
    o = layout(df, chunk_rows)
    before = o.frame(-n, -1)
    full = F.count(F.lit(1)).over(before) >= n
    q = F.col("quantity").cast("double")
    rows = o.chunked(before=n).select(
        "symbol", "seq", "buy_agent", "sell_agent", *HELPERS,
        F.when(full, F.sum(q * q).over(before) / (F.sum(q).over(before) * F.sum(q).over(before))).alias("volume_hhi"),
        F.when(full, F.try_divide(F.stddev_samp(q).over(before), F.avg(q).over(before))).alias("volume_cv"))
    return o.finish(add_sliding(rows, {
        "buyers": ("distinct", "buy_agent", 1 - n, 0, 0), "sellers": ("distinct", "sell_agent", 1 - n, 0, 0),
        "buyer_hhi": ("hhi", "buy_agent", -n, -1, n), "top_buyer_share": ("top_share", "buy_agent", -n, -1, n)})).drop("buy_agent", "sell_agent")


def range_sums(df: DataFrame, seconds: list[int], chunk_rows: int | None = None) -> DataFrame:
    """Volume in the last s seconds, for each s."""
    q = F.col("quantity")
    spec = {f"volume_{s}s": ("sum", q, s) for s in seconds}
    return time_values(df, KEYS, "ts", spec, chunk_rows=chunk_rows).select("symbol", "seq", *spec)


def shifts(df: DataFrame, ks: list[int], chunk_rows: int | None = None) -> DataFrame:
    o = layout(df, chunk_rows)
    w, p = o.window, F.col("price")
    cols = []
    for k in ks:
        cols += [F.lag(p, k).over(w).alias(f"lag_{k}"), F.lead(p, k).over(w).alias(f"lead_{k}"),
                 (p - F.lag(p, k).over(w)).alias(f"diff_{k}"), wn.pct_change(p, w, k).alias(f"ret_{k}")]
    return o.finish(o.chunked(before=max(ks), after=max(ks)).select("symbol", "seq", "_own", *cols))


def cumulative(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Cumulative delta, on-balance volume, expanding VWAP, and drawdown from the running high."""
    o = layout(df, chunk_rows)
    q, p = F.col("quantity"), F.col("price")
    rows = o.chunked(before=1).withColumn("_d", p - F.lag(p).over(o.window))
    signed = F.when(F.col("side") == "buy", q).when(F.col("side") == "sell", -q).otherwise(0)
    obv = F.when(F.col("_d") > 0, q).when(F.col("_d") < 0, -q).otherwise(0)
    out = o.running(rows, cvd=("sum", signed), obv=("sum", obv), _pv=("sum", p * q), _cv=("sum", q),
                    _peak=("max", p))
    return out.select("symbol", "seq", "cvd", "obv", (F.col("_pv") / F.col("_cv")).alias("vwap"),
                      ((p - F.col("_peak")) / F.col("_peak")).alias("drawdown"))


def bucket_position(df: DataFrame, bucket: Column, chunk_rows: int | None = None) -> DataFrame:
    """Number of earlier rows of the key in the same time bucket (the key's order follows time)."""
    o = layout(df, chunk_rows)
    rows = o.chunked(before=1).withColumn("_b", bucket)
    rows = rows.withColumn("_start", F.when(
        F.lag("_b").over(o.window).isNull() | (F.lag("_b").over(o.window) != F.col("_b")), F.col("_rn")))
    out = o.running(rows, _from=("max", F.col("_start")))
    return out.select("symbol", "seq", (F.col("_rn") - F.col("_from")).alias("position"))


def streaks(df: DataFrame, value: Column, chunk_rows: int | None = None) -> DataFrame:
    """Run length of equal consecutive values, counted up to the row; ``run`` numbers the runs."""
    o = layout(df, chunk_rows)
    rows = o.chunked(before=1).withColumn("_x", value)
    changed = ~F.lag("_x").over(o.window).eqNullSafe(F.col("_x")) | (F.col("_rn") == 1)
    rows = rows.withColumn("_ch", changed)
    out = o.running(rows, run=("sum", F.col("_ch").cast("long")), _from=("max", F.when(F.col("_ch"), F.col("_rn"))))
    return out.withColumn("length", F.col("_rn") - F.col("_from") + 1).withColumnRenamed("_x", "value")


def longest_runs(df: DataFrame, value: Column, chunk_rows: int | None = None) -> DataFrame:
    return streaks(df, value, chunk_rows).groupBy("symbol", "value").agg(
        F.max("length").alias("longest"), F.countDistinct("run").alias("runs"))


def filled(df: DataFrame, col: str, limit: int, chunk_rows: int | None = None) -> DataFrame:
    """Forward fill, backward fill, forward fill over at most ``limit`` rows, and linear interpolation."""
    o = layout(df, chunk_rows)
    x = F.col(col)
    at = F.when(x.isNotNull(), F.struct(x.alias("v"), F.col("_rn").alias("i")))
    out = o.running(o.chunked(), _p=("last", at), _n=("next", at))
    gap = F.col("_n.i") - F.col("_p.i")
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("_rn") - F.col("_p.i")) / F.nullif(gap, F.lit(0))
    return out.select(
        "symbol", "seq", F.col("_p.v").alias("ffill"), F.col("_n.v").alias("bfill"),
        F.when(F.col("_rn") - F.col("_p.i") <= limit, F.col("_p.v")).alias("ffill_limit"),
        F.when(x.isNotNull(), x).when(F.col("_n").isNull(), F.col("_p.v")).otherwise(line).alias("linear"))


def centred_extremes(df: DataFrame, half: int, chunk_rows: int | None = None) -> DataFrame:
    """Highest and lowest price of the rows around; looks ahead by ``half`` rows on purpose."""
    o = layout(df, chunk_rows)
    f = o.frame(-half, half)
    full = F.count("price").over(f) == 2 * half + 1
    return o.finish(o.chunked(half, half).select(
        "symbol", "seq", "_own",
        (full & (F.col("price") == F.max("price").over(f))).cast("int").alias("swing_high"),
        (full & (F.col("price") == F.min("price").over(f))).cast("int").alias("swing_low")))


def randomness(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Runs above/below the exact median, and lag-1 autocorrelation."""
    med = exact_quantiles(df, KEYS, "price", {"med": 0.5}, chunk_rows)
    o = layout(df.join(small_side(med), "symbol"), chunk_rows)
    above = F.col("price") > F.col("med")
    rows = o.chunked(before=1).withColumn("_a", above).withColumn("_prev", F.lag("price").over(o.window))
    rows = rows.withColumn("_turn", (F.lag("_a").over(o.window) != F.col("_a")).cast("long"))
    return rows.where("_own").groupBy("symbol").agg(
        (F.sum(F.coalesce("_turn", F.lit(0))) + 1).alias("runs"), wn.corr(F.col("price"), F.col("_prev")).alias("autocorr"))


def crossings(df: DataFrame, fast: int, slow: int, chunk_rows: int | None = None) -> DataFrame:
    """1 / -1 where the fast mean crosses above / below the slow mean."""
    o = layout(df, chunk_rows)
    w = o.window
    d = wn.rmean(F.col("price"), w, fast) - wn.rmean(F.col("price"), w, slow)
    rows = o.chunked(before=slow).withColumn("_s", F.round(d, 9))
    before = F.lag("_s").over(w)
    return o.finish(rows.select("symbol", "seq", "_own", F.when((F.col("_s") > 0) & (before <= 0), 1).when(
        (F.col("_s") < 0) & (before >= 0), -1).otherwise(0).alias("cross")))


def rank_within(df: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """Top n rows per key; Spark keeps only n rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "seq")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
