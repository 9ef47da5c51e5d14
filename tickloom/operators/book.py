"""Order-book microstructure: levels in arrays, top-of-book series, and books joined to trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import joins
from tickloom.operators.ordered import lay_out, time_values
from tickloom.operators.windows import clip, div, last_rows, pct_change, rmean, rstd, rsum

# Weights of the first three levels in the weighted imbalance.
LEVEL_WEIGHTS = [0.5, 0.3, 0.2]


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _vol(side: str, level: int) -> Column:
    return F.element_at(F.col(f"{side}_volumes"), level)


def level_imbalance(book: DataFrame) -> DataFrame:
    """Imbalance per level, weighted imbalance, log pressure and skew of three levels."""
    ratio = lambda i: (_vol("bid", i) - _vol("ask", i)) / (_vol("bid", i) + _vol("ask", i) + 1)
    bid3, ask3 = _sum(F.slice("bid_volumes", 1, 3)), _sum(F.slice("ask_volumes", 1, 3))
    return book.withColumns(
        {f"imbalance_l{i}": ratio(i) for i in range(1, 6)}
        | {f"difference_l{i}": _vol("bid", i) - _vol("ask", i) for i in range(1, 6)}
        | {"imbalance_weighted": sum((ratio(i + 1) * w for i, w in enumerate(LEVEL_WEIGHTS)), F.lit(0.0)),
           "pressure": F.log(bid3 + 1) - F.log(ask3 + 1), "skew": (bid3 - ask3) / (bid3 + ask3 + 1)})


def depth(book: DataFrame) -> DataFrame:
    """Cumulative depth per level, ratio, share of the first level, price slope, micro price."""
    cum = lambda side, i: _sum(F.slice(f"{side}_volumes", 1, i))
    bid, ask = cum("bid", 5), cum("ask", 5)
    b1, a1 = _vol("bid", 1), _vol("ask", 1)
    pb, pa = F.element_at("bid_prices", 1), F.element_at("ask_prices", 1)
    micro = (pb * a1 + pa * b1) / (b1 + a1 + 1)
    return book.withColumns(
        {f"{s}_depth_{i}": cum(s, i) for s in ("bid", "ask") for i in (1, 3, 5)}
        | {"total_depth": bid + ask, "depth_ratio": bid / (ask + 1), "bid_share_l1": b1 / (bid + 1),
           "ask_share_l1": a1 / (ask + 1), "bid_slope": (pb - F.element_at("bid_prices", 3)) / 2,
           "ask_slope": (F.element_at("ask_prices", 3) - pa) / 2,
           "micro_price": micro, "micro_deviation": micro - (pb + pa) / 2})


def _levels(c: str, depth: int | None) -> Column:
    """The first ``depth`` levels of a side, all by default."""
    return F.slice(c, 1, depth) if depth else F.col(c)


def depth_analysis(book: DataFrame, depth: int | None = None) -> DataFrame:
    """Depth of ``depth`` levels (all by default), imbalance, depth-weighted mid and liquidity score."""
    bid, ask = _sum(_levels("bid_volumes", depth)), _sum(_levels("ask_volumes", depth))
    pb, pa = F.element_at("bid_prices", 1), F.element_at("ask_prices", 1)
    bps = (pa - pb) / ((pa + pb) / 2) * 10000
    return book.withColumns({
        "bid_depth": bid, "ask_depth": ask, "depth_imbalance": F.coalesce(F.try_divide(bid - ask, bid + ask), F.lit(0.0)),
        "weighted_mid": F.coalesce(F.try_divide(pb * ask + pa * bid, bid + ask), (pb + pa) / 2),
        "liquidity_score": F.least((bid + ask) / 1000, F.lit(1.0)) * 0.7 + F.greatest(F.lit(0.0), 1 - bps / 50) * 0.3})


def major_levels(book: DataFrame, multiple: float = 2.0, depth: int | None = None) -> DataFrame:
    """One row per level, of the first ``depth`` (all by default), whose volume exceeds ``multiple`` times the mean of its side."""
    def side(s: str) -> DataFrame:
        vols = _levels(f"{s}_volumes", depth)
        lv = book.select("symbol", "seq", (_sum(vols) / F.size(vols)).alias("mean"),
                         F.posexplode(F.arrays_zip(_levels(f"{s}_prices", depth).alias("price"), vols.alias("volume"))))
        return lv.select("symbol", "seq", F.lit(s).alias("side"), (F.col("pos") + 1).alias("level"),
                         F.col("col.price").alias("price"), F.col("col.volume").alias("volume"),
                         F.try_divide("col.volume", "mean").alias("significance")
                         ).where(F.col("significance") > multiple)
    return side("bid").unionByName(side("ask"))


def liquidity_gaps(book: DataFrame, basis_points: float = 1.0, depth: int | None = None) -> DataFrame:
    """Number and widest size of price gaps above three times the expected step, per side."""
    def gaps(s: str) -> Column:
        p = _levels(f"{s}_prices", depth)
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.abs(a - b))
        return F.filter(steps, lambda g: g > F.element_at(p, 1) * (basis_points / 10000) * 3)
    return book.withColumns({f"{s}_gaps": F.size(gaps(s)) for s in ("bid", "ask")}
                            | {f"{s}_widest": F.array_max(gaps(s)) for s in ("bid", "ask")})


def map_book(book: DataFrame) -> DataFrame:
    """Depth, spread, imbalance and score of a book held as price-to-volume maps."""
    b = book.withColumns({"bids": F.map_from_arrays("bid_prices", "bid_volumes"), "asks": F.map_from_arrays("ask_prices", "ask_volumes")})
    bid, ask = _sum(F.map_values("bids")), _sum(F.map_values("asks"))
    spread = F.array_min(F.map_keys("asks")) - F.array_max(F.map_keys("bids"))
    return b.withColumns({"bid_depth": bid, "ask_depth": ask, "spread": spread,
                          "imbalance": F.coalesce(F.try_divide(bid - ask, bid + ask), F.lit(0.0)),
                          "score": F.when((bid + ask > 0) & (spread > 0), (bid + ask) / spread).otherwise(0.0)})


def book_patterns(book: DataFrame, n: int, long_n: int, chunk_rows: int | None = None) -> DataFrame:
    """Large orders, icebergs, sweeps, accumulation and distribution, over ordered snapshots."""
    o = lay_out(level_imbalance(book), ["symbol"], ["seq"], chunk_rows)
    w = o.window
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    cols = {}
    for s in ("bid", "ask"):
        v1, v2 = _vol(s, 1), _vol(s, 2)
        cols[f"large_{s}"] = flag(v1 > 3 * rmean(v1, w, long_n))
        cols[f"iceberg_{s}"] = flag((F.abs(v1 - F.lag(v1).over(w)) < v1 * 0.1) & (v1 > rmean(v1, w, n)))
        cols[f"sweep_{s}"] = flag((v1 == 0) & (v2 == 0))
    p = F.col("pressure")
    mean, std = rmean(p, w, n), rstd(p, w, n)
    cols |= {"accumulation": flag(p > mean + std), "distribution": flag(p < mean - std)}
    rows = o.chunked(before=max(n, long_n)).withColumns(cols)
    return o.finish(rows, "symbol", "seq", *cols)


def liquidity_drop(book: DataFrame, n: int = 10, ratio: float = 0.7, chunk_rows: int | None = None, depth: int | None = None) -> DataFrame:
    """Snapshots whose score falls below ``ratio`` times the mean of the last n."""
    scored = depth_analysis(book, depth).select("symbol", "seq", "liquidity_score")
    o = lay_out(scored, ["symbol"], ["seq"], chunk_rows)
    rows = o.chunked(before=n).withColumn("mean_score", rmean(F.col("liquidity_score"), o.window, n))
    return o.finish(rows.withColumn("low_liquidity", F.coalesce(
        (F.col("liquidity_score") < F.col("mean_score") * ratio).cast("int"), F.lit(0))))


def spread_series(tops: DataFrame, n: int = 10, long_n: int = 50) -> DataFrame:
    """Spread, its means and deviation, quote changes and stability of a top-of-book series."""
    w = Window.partitionBy("k").orderBy("ts")
    t = tops.withColumn("spread", F.col("ask") - F.col("bid")).withColumn("mid", (F.col("ask") + F.col("bid")) / 2)
    t = t.withColumn("ret", pct_change(F.col("mid"), w))
    changed = lambda c: (F.col(c) != F.coalesce(F.lag(c).over(w), F.lit(float("-inf")))).cast("int")
    t = t.withColumns({"_cb": changed("bid"), "_ca": changed("ask")})
    day_vol = F.stddev_samp("mid").over(Window.partitionBy("k", F.to_date("ts")))
    return t.withColumns({
        "spread_pct": F.col("spread") / F.col("mid") * 100, "spread_ma": rmean(F.col("spread"), w, n),
        "spread_ma_long": rmean(F.col("spread"), w, long_n), "spread_std": rstd(F.col("spread"), w, long_n),
        "spread_norm": F.try_divide(F.col("spread"), day_vol),
        "bid_changes": rsum(F.col("_cb"), w, n), "ask_changes": rsum(F.col("_ca"), w, n),
        "bid_stability": rstd(F.col("bid"), w, n), "ask_stability": rstd(F.col("ask"), w, n)})


def velocity(tops: DataFrame, seconds: int) -> DataFrame:
    """Mean step of spread and pressure per second over a time range."""
    w = Window.partitionBy("k").orderBy("ts")
    f = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    t = tops.withColumns({"spread": F.col("ask") - F.col("bid"), "pressure": F.log(F.col("bid_qty") + 1) - F.log(F.col("ask_qty") + 1)})
    t = t.withColumns({c: (F.col(x) - F.lag(x).over(w)) / seconds for c, x in (("_ds", "spread"), ("_dp", "pressure"))})
    return t.withColumns({"spread_velocity": F.avg("_ds").over(f), "pressure_velocity": F.avg("_dp").over(f)})


def top_series(tops: DataFrame) -> DataFrame:
    """Spread, mid, size imbalance, pressure, returns and volatility of a top-of-book series."""
    w = Window.partitionBy("k").orderBy("ts")
    b, a = F.col("bid_qty"), F.col("ask_qty")
    t = tops.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2})
    t = t.withColumns({"qty_imbalance": (b - a) / (b + a), "pressure": b / (b + a), **{
        f"ret_{k}": pct_change(F.col("mid"), w, k) for k in (1, 5, 10)}})
    return t.withColumns({"vol_10": rstd(F.col("ret_1"), w, 10), "vol_30": rstd(F.col("ret_1"), w, 30),
                          "spread_ma_10": rmean(F.col("spread"), w, 10), "bid_qty_10": rmean(b, w, 10)})


def price_impact_measures(ticks: DataFrame, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Kyle's lambda (two forms) and Amihud illiquidity over the last n ticks."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    w, q = o.window, F.col("quantity")
    rows = o.chunked(before=n + 5).withColumns({
        "_dp": F.col("price") - F.lag("price").over(w), "_ret": pct_change(F.col("price"), w),
        "_ret5": pct_change(F.col("price"), w, 5)})
    signed = F.when(F.col("side") == "buy", q).when(F.col("side") == "sell", -q).otherwise(0)
    rows = rows.withColumns({"_sv": q * F.signum("_dp"), "_il": F.abs("_ret") / (q + 1), "_fl": signed})
    return o.finish(rows.withColumns({
        "kyle": F.try_divide(rstd(F.col("_dp"), w, n), rstd(F.col("_sv"), w, n)),
        "amihud": rmean(F.col("_il"), w, n),
        "kyle_flow": F.abs("_ret5") / clip(F.abs(rsum(F.col("_fl"), w, n)), 1.0)}),
        "symbol", "seq", "kyle", "amihud", "kyle_flow")


def effective_spread(trades: DataFrame, tops: DataFrame) -> DataFrame:
    """Twice the distance of a trade from the latest mid price."""
    t = joins.asof(trades, tops.withColumn("seq", F.lit(0).cast("long")), ["k"], ["bid", "ask"])
    return t.withColumn("effective_spread", 2 * F.abs(F.col("price") - (F.col("r_bid") + F.col("r_ask")) / 2))


def book_trade_flow(quotes: DataFrame, trades: DataFrame, seconds: int, chunk_rows: int | None = None) -> DataFrame:
    """Order-flow imbalance and share of volume at or below the quote, from the as-of trade of each quote."""
    j = joins.asof(quotes, trades, ["k"], ["price", "quantity"], chunk_rows=chunk_rows)
    part = lambda c: F.when(c, F.col("r_quantity")).otherwise(0)
    sums = {"_b": F.col("side") == "bid", "_a": F.col("side") == "ask", "_l": F.col("r_price") <= F.col("price"), "_h": F.col("r_price") > F.col("price")}
    t = time_values(j, ["k"], "ts", {n: ("sum", part(c), seconds) for n, c in sums.items()}, chunk_rows=chunk_rows)
    buy, sell, low, high = (F.coalesce(n, F.lit(0)) for n in sums)
    return t.select("k", "seq", ((buy - sell) / (buy + sell + 1)).alias("ofi"), (low / (low + high + 1)).alias("at_bid_share"),
                    (high / (low + 1)).alias("aggressiveness"))


def combine(offer: DataFrame, price: DataFrame, keys: list[str]) -> DataFrame:
    return joins.full_outer({"offer": offer, "price": price}, keys)


def regular_prints(ticks: DataFrame, minimum: int, size_cv: float, gap_cv: float, chunk_rows: int | None = None) -> DataFrame:
    """Price levels of a day that trade in similar sizes at similar intervals."""
    t = ticks.withColumn("day", F.to_date("ts")).withColumn("level", F.floor("price"))
    o = lay_out(t, ["symbol", "day", "level"], ["ts", "seq"], chunk_rows)
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(o.window)) / 1e6
    rows = o.chunked(before=1).withColumn("_gap", gap).where("_own")
    return rows.groupBy("symbol", "day", "level").agg(
        F.count(F.lit(1)).alias("executions"), F.avg("quantity").alias("avg_volume"),
        F.try_divide(F.stddev_pop("quantity"), F.avg("quantity")).alias("size_cv"),
        F.try_divide(F.stddev_pop("_gap"), F.avg("_gap")).alias("gap_cv")).where(
        (F.col("executions") >= minimum) & (F.col("size_cv") < size_cv) & (F.col("gap_cv") < gap_cv))


def hidden_liquidity(trades: DataFrame, n: int, large: float, chunk_rows: int | None = None) -> DataFrame:
    """Executed against visible volume over the last n trades, and share of quiet large trades.

    Needs ``side``, ``quantity``, ``price``, ``visible_bid`` and ``visible_ask``.
    """
    o = lay_out(trades, ["k"], ["ts", "seq"], chunk_rows)
    f = o.last(n)
    hit = lambda s: F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0)).over(f)
    rows = o.chunked(before=n).withColumns({
        "_bid": hit("sell"), "_ask": hit("buy"), "_m": F.avg("quantity").over(f),
        "_l": F.collect_list(F.struct(F.col("price").alias("p"), F.col("quantity").alias("q"))).over(f)})
    vb, va = F.col("visible_bid"), F.col("visible_ask")
    rows = rows.withColumns({
        "hidden_bid": F.when(F.col("_bid") > vb * 1.5, F.col("_bid") - vb).otherwise(0.0),
        "hidden_ask": F.when(F.col("_ask") > va * 1.5, F.col("_ask") - va).otherwise(0.0),
        "_big": F.transform(F.filter("_l", lambda x: x.q > F.col("_m") * large), lambda x: x.p)})
    k = F.size("_big")
    mean = _sum(F.col("_big")) / k
    spread = F.sqrt(F.aggregate("_big", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / k)
    return o.finish(rows.withColumns({
        "hidden_ratio": F.try_divide(F.col("hidden_bid") + F.col("hidden_ask"), vb + va),
        "large_share": k / F.size("_l"), "quiet": F.when(k > 0, spread / mean)}),
        "k", "seq", "hidden_bid", "hidden_ask", "hidden_ratio", "large_share", "quiet")


def consumption(tops: DataFrame, trades: DataFrame, width: str) -> DataFrame:
    """Consumption, replenishment and aggressive share between consecutive snapshots, with trend."""
    wk = Window.partitionBy("k").orderBy("ts")
    o = lay_out(trades, ["k"], ["ts", "seq"])
    moves = o.finish(o.chunked(before=1).withColumn("move", F.abs(F.col("price") - F.lag("price").over(o.window))))
    m = moves.withColumn("b", F.window("ts", width).start)
    per = m.groupBy("k", "b").agg(F.sum("quantity").alias("executed"), F.avg("move").alias("mean_move"), F.count(F.lit(1)).alias("n"))
    hot = m.join(per, ["k", "b"]).groupBy("k", "b", "executed", "n").agg(
        F.sum((F.coalesce(F.col("move"), F.lit(0.0)) > F.col("mean_move") * 2).cast("int")).alias("big"))
    t = tops.withColumn("liquidity", F.col("bid_qty") + F.col("ask_qty")).join(
        hot.select("k", F.col("b").alias("ts"), "executed", (F.col("big") / F.col("n")).alias("aggressive")), ["k", "ts"], "left")
    ex = F.coalesce("executed", F.lit(0))
    before = F.lag("liquidity").over(wk)
    t = t.withColumns({"executed": ex, "rate": F.try_divide(ex, before), "net_change": F.col("liquidity") - before + ex,
                       "_i": F.row_number().over(wk)})
    f = last_rows(wk, 20)
    return t.withColumns({
        "replenishment": F.try_divide(F.greatest(F.lit(0.0), F.col("net_change")), F.col("executed")),
        "trend": F.when(F.count("rate").over(f) >= 10, F.regr_slope("rate", "_i").over(f))})


def event_features(quotes: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per-key steps, log size, position flags and weighted pressure, with the bucket's flow on each row."""
    o = lay_out(joins.attach_flow(quotes, ["k", "bucket"]), ["k"], ["ts", "seq"], chunk_rows)
    w = o.window
    pos, top = F.col("position"), F.col("position") <= 5
    side = lambda s: F.when((F.col("side") == s) & top, F.col("quantity") / (pos + 1)).otherwise(0.0)
    rows = o.chunked(before=1).withColumns({
        "price_diff": F.col("price") - F.lag("price").over(w), "price_pct": pct_change(F.col("price"), w),
        "quantity_log": F.log1p("quantity"), "is_top": top.cast("int"), "is_deep": (pos > 20).cast("int"),
        "bid_pressure": side("bid"), "ask_pressure": side("ask"),
        "update_rate": 1 / (F.coalesce((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6, F.lit(1.0)) + 0.001)})
    return o.finish(rows)


def tick_against_book(ticks: DataFrame, quotes: DataFrame, tolerance: float) -> DataFrame:
    """Trade price and size against the latest quote within ``tolerance`` seconds."""
    j = joins.asof(ticks, quotes, ["k"], ["price", "quantity", "side"], tolerance=tolerance)
    p, q = F.col("price"), F.col("quantity")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return j.withColumns({
        "price_vs_book": (p - F.col("r_price")) / F.col("r_price") * 100, "above_book": flag(p > F.col("r_price")),
        "below_book": flag(p < F.col("r_price")), "qty_vs_book": q / (F.col("r_quantity") + 1),
        "larger_than_book": flag(q > F.col("r_quantity")), "matches_bid": flag(F.col("r_side") == "bid")})
