"""Grouped summaries of ticks, quotes, bars and predictions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import exact_quantiles, lay_out, time_values
from tickloom.operators.windows import corr, div, last_rows, pct_change, rmean
from tickloom.session import small_side


def infer_side(ticks: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Side from the tick rule: a price that did not fall is a buy; the first tick counts as buy."""
    o = lay_out(ticks.drop("side"), ["symbol"], ["ts", "seq"], chunk_rows)
    diff = F.col("price") - F.lag("price").over(o.window)
    return o.finish(o.chunked(before=1).withColumn(
        "side", F.when(F.coalesce(diff, F.lit(0.0)) >= 0, "buy").otherwise("sell")))


def book_tops(quotes: DataFrame, width: str, both: bool = False) -> DataFrame:
    """Last price and mean size per side and bucket; ``both`` keeps buckets with two sides."""
    at, q = F.struct("ts", "seq"), F.col("quantity")
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    out = quotes.groupBy("k", F.window("ts", width).alias("w")).agg(
        F.max_by(F.when(bid, F.col("price")), F.when(bid, at)).alias("bid"),
        F.max_by(F.when(ask, F.col("price")), F.when(ask, at)).alias("ask"),
        F.avg(F.when(bid, q)).alias("bid_qty"), F.avg(F.when(ask, q)).alias("ask_qty"),
    ).select("k", F.col("w.start").alias("ts"), "bid", "ask", "bid_qty", "ask_qty")
    return out.where("bid IS NOT NULL AND ask IS NOT NULL") if both else out


def depth_by_side(quotes: DataFrame, width: str) -> DataFrame:
    return quotes.groupBy("k", "side", F.window("ts", width).alias("w")).agg(
        F.sum("quantity").alias("qty_sum"), F.avg("quantity").alias("qty_mean"),
        F.count(F.lit(1)).alias("qty_count"), F.min("price").alias("price_min"),
        F.max("price").alias("price_max"), F.stddev_samp("price").alias("price_std"),
    ).select("k", "side", F.col("w.start").alias("ts"), "qty_sum", "qty_mean", "qty_count",
             "price_min", "price_max", "price_std")


def type_counts(events: DataFrame, keys: list, types: list[str], over: str, under: str) -> DataFrame:
    wide = events.groupBy(*keys).pivot("event_type", types).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("update_ratio", F.col(over) / (F.col(under) + 1))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)


def attach_counts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Group size on every row: aggregate with partials, then join (no group is gathered)."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def volume_profile(ticks: DataFrame, bins: int) -> DataFrame:
    """Volume per equal-width price bin, point of control, its share, and a profile score."""
    span = ticks.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    binned = ticks.join(small_side(span), "symbol").withColumn(
        "bin", F.when(F.col("hi") > F.col("lo"), F.least(
            F.greatest(F.ceil((F.col("price") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(1)),
            F.lit(bins))).otherwise(1).cast("long"))
    per = binned.groupBy("symbol", "lo", "hi", "bin").agg(F.sum("quantity").alias("vol"))
    prof = per.groupBy("symbol", "lo", "hi").agg(
        F.min_by("bin", F.struct(-F.col("vol"), "bin")).alias("poc_bin"), F.max("vol").alias("poc_volume"),
        F.sum("vol").alias("total"),
        F.sum(F.col("vol").cast("double") * F.col("vol")).alias("ss"))
    mean = F.col("total") / bins
    std = F.sqrt((F.col("ss") - bins * mean * mean) / (bins - 1))
    share = F.col("poc_volume") / F.col("total")
    return prof.select(
        "symbol", "poc_bin", "poc_volume", share.alias("poc_share"),
        (F.col("lo") + (F.col("poc_bin") - 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("poc_price"),
        ((share + 1 / (1 + F.exp(-(std / mean)))) / 2).alias("profile_score"))


def price_deciles(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Volume of a bar against the mean volume of its price decile."""
    probs = {f"p{i}": i / 10 for i in range(1, 10)}
    edges = exact_quantiles(bars, ["symbol"], "close", probs, chunk_rows)
    with_bin = bars.join(small_side(edges), "symbol").withColumn(
        "decile", (F.lit(0) + sum(((F.col("close") > F.col(p)).cast("int") for p in probs), F.lit(0))).cast("long"))
    mean = with_bin.groupBy("symbol", "decile").agg(F.avg("volume").alias("decile_volume"))
    return with_bin.join(mean, ["symbol", "decile"]).select(
        "symbol", "ts", "decile", (div(F.col("volume"), F.col("decile_volume")) - 1).alias("deviation"))


def slice_stats(ticks: DataFrame) -> DataFrame:
    at = F.struct("ts", "seq")
    last, first = F.max_by("price", at), F.min_by("price", at)
    return ticks.groupBy("symbol").agg(
        last.alias("last_price"), F.avg("price").alias("mean_price"),
        F.stddev_samp("price").alias("std_price"), (last - first).alias("price_change"),
        ((last / first - 1) * 100).alias("price_change_pct"), F.sum("quantity").alias("total_volume"),
        F.avg("quantity").alias("mean_volume"), F.stddev_samp("quantity").alias("volume_std"))


def large_trade_imbalance(ticks: DataFrame, factor: float = 2.0) -> DataFrame:
    """Signed volume share of trades above ``factor`` times the exact median size."""
    med = exact_quantiles(ticks, ["symbol"], "quantity", {"med": 0.5})
    big = ticks.join(small_side(med), "symbol").where(F.col("quantity") > F.col("med") * factor)
    buy = F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0))
    sell = F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0))
    return big.groupBy("symbol").agg(buy.alias("buy_volume"), sell.alias("sell_volume")).withColumn(
        "imbalance", F.coalesce(div(F.col("buy_volume") - F.col("sell_volume"),
                                    F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0)))


def price_action_quality(bars: DataFrame) -> DataFrame:
    """Trend fit, volatility and smoothness of the closes of each day."""
    w = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")
    r = bars.withColumn("pos", F.row_number().over(w)).withColumn("ret", pct_change(F.col("close"), w))
    r = r.withColumn("turn", (F.signum("ret") != F.lag(F.signum("ret")).over(w)).cast("int"))
    n = F.count("ret")
    fit = F.regr_r2("close", "pos")
    mean = F.abs(F.avg("ret"))
    calm = F.when(mean > 0, 1 / (1 + F.stddev_samp("ret") / mean)).otherwise(0.5)
    smooth = 1 - F.coalesce(F.sum("turn"), F.lit(0)) / n
    return r.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("close", "pos").alias("slope"), fit.alias("r2"),
        smooth.alias("smoothness"), ((fit + calm + smooth) / 3).alias("quality")).where("n >= 10")


def monthly_returns(bars: DataFrame) -> DataFrame:
    """Per symbol: month counts by sign, best, worst and monthly Sharpe of compounded returns."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = bars.withColumn("ret", pct_change(F.col("close"), w)).where("ret IS NOT NULL")
    m = r.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(
        (F.exp(F.sum(F.log1p("ret"))) - 1).alias("m"))
    return m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("months"), F.sum((F.col("m") > 0).cast("int")).alias("positive"),
        F.sum((F.col("m") < 0).cast("int")).alias("negative"), F.max("m").alias("best"),
        F.min("m").alias("worst"),
        (F.try_divide(F.avg("m"), F.stddev_pop("m")) * F.sqrt(F.lit(12.0))).alias("sharpe"))


def correlation_pairs(df: DataFrame, cols: list[str], threshold: float = 0.95) -> DataFrame:
    """All column pairs with their Pearson correlation, from one aggregation."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("p")).select(
        "p.a", "p.b", "p.corr", (F.abs("p.corr") > threshold).cast("int").alias("redundant"))


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: count, nulls, mean, std, min, max (one aggregation, then a stack)."""
    parts = []
    for c in cols:
        parts += [F.count(c).alias(f"{c}_n"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls"),
                  F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                  F.min(F.col(c).cast("double")).alias(f"{c}_min"), F.max(F.col(c).cast("double")).alias(f"{c}_max")]
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"), *[F.col(f"{c}_{s}").alias(s) for s in ("n", "nulls", "mean", "std", "min", "max")])
        for c in cols])
    return df.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")


def trade_buffer(ticks: DataFrame, n: int, seconds: int, chunk_rows: int | None = None) -> DataFrame:
    """VWAP and aggressor ratio of the last n trades, and trades per second in a time window."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    f = o.last(n)
    pv = F.sum(F.col("price") * F.col("quantity")).over(f)
    rows = o.chunked(before=n - 1).withColumn("vwap", pv / F.sum("quantity").over(f)).withColumn(
        "aggressor_ratio", F.avg((F.col("side") == "buy").cast("double")).over(f))
    left = o.finish(rows, "symbol", "seq", "vwap", "aggressor_ratio")
    right = time_values(ticks, ["symbol"], "ts", {"_n": ("sum", F.lit(1), seconds)}, chunk_rows=chunk_rows).select(
        "symbol", "seq", (F.col("_n") / float(seconds)).alias("intensity"))
    return left.join(right, ["symbol", "seq"])


def candle_buffer(bars: DataFrame, n: int) -> DataFrame:
    """Close, extremes, mean volume and return volatility of the last n bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f = last_rows(w, n)
    return bars.withColumn("ret", pct_change(F.col("close"), w)).select(
        "symbol", "ts", F.col("close").alias("last"), F.max("high").over(f).alias("high"),
        F.min("low").over(f).alias("low"), F.avg("volume").over(f).alias("mean_volume"), "ret",
        F.when(F.count("ret").over(f) >= 2, F.stddev_pop("ret").over(f)).alias("volatility"))


def volume_pace(bars: DataFrame) -> DataFrame:
    """Current volume, mean of five bars, and their change against the ten bars before."""
    w = Window.partitionBy("symbol").orderBy("ts")
    before = w.rowsBetween(-14, -5)
    return bars.select(
        "symbol", "ts", F.col("volume").alias("pace"), rmean(F.col("volume"), w, 5).alias("pace_5"),
        F.when(F.count("volume").over(before) >= 10,
               (F.avg("volume").over(last_rows(w, 5)) / F.avg("volume").over(before) - 1) * 100).alias("acceleration"))


def accuracy_by(preds: DataFrame, bucket: Column, name: str) -> DataFrame:
    return preds.groupBy(bucket.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"),
        F.avg("confidence").alias("confidence"))
