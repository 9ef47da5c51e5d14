"""Order flow, tape reading, footprints and agent behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.aggregates import top_values
from tickloom.operators.ordered import Ordered, exact_quantiles, lay_out, time_values
from tickloom.operators.scan import recurrence
from tickloom.operators.windows import (
    clip, distinct_in, div, last_rows, pct_change, percentile_rank, rmean, rmedian, rstd, rsum)
from tickloom.session import pin, small_side

# Base confidence of the footprint patterns.
FOOTPRINT_BASE = {"p_reversal": 0.7, "b_reversal": 0.65, "exhaustion": 0.75,
                  "initiative_buying": 0.65, "initiative_selling": 0.65}


def _layout(ticks: DataFrame, chunk_rows: int | None) -> Ordered:
    return lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)


def _buy(x: Column) -> Column:
    return F.when(F.col("side") == "buy", x).otherwise(0)


def _sell(x: Column) -> Column:
    return F.when(F.col("side") == "sell", x).otherwise(0)


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def _balance(buy: Column, sell: Column) -> Column:
    return F.coalesce(div(buy - sell, buy + sell), F.lit(0.0))


def ofi_time(ticks: DataFrame, seconds: list[int], chunk_rows: int | None = None) -> DataFrame:
    """Order-flow imbalance of the last s seconds, for each s."""
    q = F.col("quantity")
    parts = {"b": _buy(q), "s": _sell(q)}
    spec = {f"_{n}{s}": ("sum", part, s) for s in seconds for n, part in parts.items()}
    t = time_values(ticks, ["symbol"], "ts", spec, chunk_rows=chunk_rows)
    return t.select("symbol", "seq", *[_balance(F.col(f"_b{s}"), F.col(f"_s{s}")).alias(f"ofi_{s}s") for s in seconds])


def flow_counts(ticks: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Imbalances and ratios over the last rows, flow momentum of two halves."""
    o = _layout(ticks, chunk_rows)
    q, one = F.col("quantity"), F.lit(1)
    f = {n: o.last(n) for n in (20, 50, 60, 100)}
    enough = F.count(one).over(f[100]) >= 10
    first, second = F.avg(q).over(o.frame(-19, -10)), F.avg(q).over(o.frame(-9, 0))
    total = lambda n: clip(F.sum(_buy(one) + _sell(one)).over(f[n]).cast("double"), 1.0)
    net = lambda n: F.sum(_buy(one) - _sell(one)).over(f[n])
    rows = o.chunked(before=110).withColumns({
        "ofi_60": _balance(F.sum(_buy(q)).over(f[60]), F.sum(_sell(q)).over(f[60])),
        "volume_imbalance": F.when(enough, _balance(F.sum(_buy(q)).over(f[100]), F.sum(_sell(q)).over(f[100]))).otherwise(0.0),
        "aggression": F.when(enough, F.avg(_buy(one)).over(f[50])).otherwise(0.5),
        "large_ratio": F.when(enough, F.avg((q > 20).cast("int")).over(f[100])).otherwise(0.0),
        "flow_momentum": F.when(F.count(one).over(f[20]) >= 20, (second - first) / first).otherwise(0.0),
        "flow_imbalance": F.when(F.count(one).over(f[20]) >= 20, net(20) / total(20)),
        "buyer_ratio": F.when(F.count(one).over(f[20]) >= 20, F.sum(_buy(one)).over(f[20]) / total(20))})
    rows = rows.withColumn("imbalance_step", F.col("flow_imbalance") - F.lag("flow_imbalance", 10).over(o.window))
    return o.finish(rows)


def flow_ewm(ticks: DataFrame, span: int, chunk_rows: int | None = None) -> DataFrame:
    """Exponentially weighted buyer minus seller share, and their sum (two linear recurrences)."""
    o = _layout(ticks, chunk_rows)
    alpha = 2.0 / (span + 1)
    seed = lambda x: F.when(F.col("_rn") == 1, x).otherwise(x * alpha)
    one = F.lit(1.0)
    a = recurrence(o, seed(_buy(one) - _sell(one)), 1 - alpha, "imbalance_ewm", ["symbol", "seq"])
    b = recurrence(o, seed(_buy(one) + _sell(one)), 1 - alpha, "intensity_ewm", ["symbol", "seq"])
    return a.join(b, ["symbol", "seq"])


def pressure(bars: DataFrame) -> DataFrame:
    """Buy/sell pressure, flow sums, cumulative delta, divergence of price and delta over ten bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    b, s = F.col("buy_volume"), F.col("sell_volume")
    t = bars.withColumns({"buy_pressure": div(b, b + s), "imbalance": _balance(b, s), "delta": b - s})
    change = div(F.col("close"), F.lag("close", 9).over(w)) - 1
    trend = rmean(F.col("delta"), w, 10)
    return t.withColumns({
        "net_flow": rsum(F.col("delta"), w, 10), "flow_ratio": div(rsum(b, w, 10), rsum(s, w, 10)),
        "pressure_ma": rmean(F.col("buy_pressure"), w, 10, 1), "acceleration": F.col("imbalance") - F.lag("imbalance").over(w),
        "cvd": F.sum("delta").over(up), "cvd_share": F.sum("delta").over(up) / F.sum("volume").over(up),
        "imbalance_z": (F.col("imbalance") - rmean(F.col("imbalance"), w, 20)) / (rstd(F.col("imbalance"), w, 20) + 1e-10),
        "divergence": F.when((change > 0) & (trend < 0), -1).when((change < 0) & (trend > 0), 1).otherwise(0)})


def run_lengths(bars: DataFrame) -> DataFrame:
    """Length of the current run of buyer-led (seller-led) bars, zero outside it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = bars.withColumn("lead", _flag(F.col("buy_trades") > F.col("sell_trades")))
    t = t.withColumn("_new", F.coalesce((F.col("lead") != F.lag("lead").over(w)).cast("int"), F.lit(1)))
    t = t.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))
    return t.withColumns({"buy_run": length * F.col("lead"), "sell_run": length * (1 - F.col("lead"))})


def intensity(ticks: DataFrame, n: int, long_n: int, chunk_rows: int | None = None) -> DataFrame:
    """One over the median gap between trades, its deviation and surge."""
    o = _layout(ticks, chunk_rows)
    w = o.window
    rows = o.chunked(before=n + long_n).withColumn("_gap", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6)
    rows = rows.withColumn("intensity", 1 / clip(rmedian(F.col("_gap"), w, n), 0.001))
    return o.finish(rows.withColumns({
        "intensity_std": rstd(F.col("intensity"), w, long_n),
        "surge": F.coalesce(F.col("intensity") / rmean(F.col("intensity"), w, long_n), F.lit(1.0)),
        "acceleration": F.col("intensity") - F.lag("intensity").over(w)}),
        "symbol", "seq", "intensity", "intensity_std", "surge", "acceleration")


def tape_speed(ticks: DataFrame, short: int, long: int, chunk_rows: int | None = None) -> DataFrame:
    """Trades and volume per second and share of large trades in two time windows, with patterns."""
    q, one, us = F.col("quantity"), F.lit(1), F.unix_micros("ts")
    spec = {f"_{n}{s}": (k, x, s) for s in (short, long) for n, k, x in (("n", "sum", one), ("q", "sum", q), ("t", "oldest", one))}
    t = pin(time_values(ticks, ["symbol"], "ts", spec, chunk_rows=chunk_rows))
    t = t.withColumns({f"_big{s}": (q > 2 * F.col(f"_q{s}") / F.col(f"_n{s}")).cast("int") for s in (short, long)})
    t = time_values(t, ["symbol"], "ts", {f"_k{s}": ("sum", F.col(f"_big{s}"), s) for s in (short, long)}, chunk_rows=chunk_rows)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    for s in (short, long):
        span = (us - F.col(f"_t{s}")) / 1e6
        t = t.withColumns({f"speed_{s}": zero(F.try_divide(F.col(f"_n{s}"), span)), f"velocity_{s}": zero(F.try_divide(F.col(f"_q{s}"), span)),
                           f"large_share_{s}": F.col(f"_k{s}") / F.col(f"_n{s}")})
    a, b = F.col(f"speed_{short}"), F.col(f"speed_{long}")
    return t.withColumns({
        "acceleration": zero(F.try_divide(a - b, b)),
        "pattern": F.when((b > 0) & (a / F.nullif(b, F.lit(0.0)) > 2), "sudden_acceleration").when(F.col(f"large_share_{long}") > 0.3, "high_intensity")})


def tape_patterns(ticks: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Sweeps, momentum, exhaustion and absorption on the last trades."""
    o = _layout(ticks, chunk_rows)
    w, p, q, us = o.window, F.col("price"), F.col("quantity"), F.unix_micros("ts")
    side, prev = F.col("side"), F.lag("side").over(w)
    dp = p - F.lag(p).over(w)
    rows = o.chunked(before=61).withColumns({
        "_up": _flag((side == "buy") & (prev == "buy") & (dp >= 0)), "_down": _flag((side == "sell") & (prev == "sell") & (dp <= 0)),
        "_rise": _flag(dp > 0), "_fall": _flag(dp < 0), "_shrink": _flag(q < F.lag(q).over(w))})
    n9, n14, f5 = o.last(9), o.last(14), o.last(5)
    full = lambda n: F.count(F.lit(1)).over(o.last(n)) >= n
    buys, sells = F.sum("_up").over(n9), F.sum("_down").over(n9)
    rise, fall, bc = F.sum("_rise").over(n14), F.sum("_fall").over(n14), F.sum(_buy(F.lit(1))).over(o.last(15))
    h1, h2 = o.frame(-29, -15), o.frame(-14, 0)
    speed = lambda f: F.try_divide(F.lit(15.0), (F.max(us).over(f) - F.min(us).over(f)) / 1e6)
    v20, base = F.sum(q).over(o.last(20)), F.avg(q).over(o.last(60)) * 20
    span = (F.max(p).over(o.last(20)) - F.min(p).over(o.last(20))) / F.avg(p).over(o.last(20)) * 100
    bv, sv = F.sum(_buy(q)).over(o.last(20)), F.sum(_sell(q)).over(o.last(20))
    return o.finish(rows.withColumns({
        "sweep": F.when(~full(10), "none").when(buys >= 4, "buy").when(sells >= 4, "sell").otherwise("none"),
        "sweep_confidence": F.when(full(10), F.least(F.greatest(buys, sells) * 0.2, F.lit(1.0))).otherwise(0.0),
        "burst": _flag(full(5) & (F.min(side).over(f5) == F.max(side).over(f5)) & (F.sum("_shrink").over(o.last(4)) == 0)),
        "momentum": F.when(~full(15), 0).when((rise > 14 * 0.7) & (bc > 7), 1).when((fall > 14 * 0.7) & (bc <= 7), -1).otherwise(0),
        "exhausted": _flag(full(30) & (F.sum(q).over(h2) < F.sum(q).over(h1) * 0.5) & (speed(h2) < speed(h1) * 0.5)),
        "absorption": F.when(full(60) & (v20 >= base * 1.1) & (span < 150), F.when(bv > sv * 1.5, "bullish").when(
            sv > bv * 1.5, "bearish").otherwise("neutral")).otherwise("none")}),
        "symbol", "seq", "sweep", "sweep_confidence", "burst", "momentum", "exhausted", "absorption")


def flow_sweeps(bars: DataFrame, level: float = 0.3, n: int = 5) -> DataFrame:
    """n bars in a row with imbalance beyond ``level``."""
    w = Window.partitionBy("symbol").orderBy("ts")
    f = last_rows(w, n)
    t = bars.withColumn("ofi", _balance(F.col("buy_volume"), F.col("sell_volume")))
    full = F.count("ofi").over(f) >= n
    return t.withColumns({
        "direction": F.when(full & (F.min("ofi").over(f) > level), "bullish").when(full & (F.max("ofi").over(f) < -level), "bearish").otherwise("none"),
        "strength": F.abs(F.avg("ofi").over(f))})


def iceberg_prints(ticks: DataFrame, width: str, minimum: int, cv: float) -> DataFrame:
    """Price levels of a time bucket with several prints of similar size."""
    g = ticks.groupBy("symbol", F.window("ts", width).alias("w"), F.floor("price").alias("level")).agg(
        F.count(F.lit(1)).alias("executions"), F.avg("quantity").alias("avg_volume"), F.stddev_pop("quantity").alias("sd"))
    return g.where((F.col("executions") >= minimum) & (F.col("sd") / F.col("avg_volume") < cv)).select(
        "symbol", F.col("w.start").alias("ts"), "level", "executions", "avg_volume",
        F.least(F.col("executions") * 0.15, F.lit(1.0)).alias("confidence"))


def absorption_bars(bars: DataFrame, volume_factor: float, move_pct: float) -> DataFrame:
    """Bars with high volume and little movement, typed by their imbalance."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = bars.withColumns({"ofi": _balance(F.col("buy_volume"), F.col("sell_volume")),
                          "strength": div(F.col("volume"), rmean(F.col("volume"), w, 20)), "move": pct_change(F.col("close"), w) * 100})
    return t.where((F.col("strength") >= volume_factor) & (F.abs("move") < move_pct)).withColumn(
        "type", F.when(F.col("ofi") > 0.2, "buying").when(F.col("ofi") < -0.2, "selling").otherwise("neutral"))


def tape_momentum(ticks: DataFrame, periods: tuple[int, ...] = (10, 30, 60), chunk_rows: int | None = None) -> DataFrame:
    """Price slope, volume change and directional share over several row horizons, and divergence."""
    o = _layout(ticks, chunk_rows)
    q = F.col("quantity")
    cols = {}
    for n in periods:
        f, half = o.last(n), n // 2
        ok = F.count(q).over(f) >= n
        first, second = F.sum(q).over(o.frame(-(n - 1), -half)), F.sum(q).over(o.frame(-half + 1, 0))
        cols |= {
            f"price_{n}": F.when(ok, F.regr_slope("price", "_rn").over(f) / F.avg("price").over(f) * 100),
            f"volume_{n}": F.when(ok, (second - first) / first),
            f"direction_{n}": F.when(ok, _balance(F.sum(_buy(q)).over(f), F.sum(_sell(q)).over(f)))}
    rows = o.chunked(before=max(periods)).withColumns(cols)
    a, b = F.col(f"price_{periods[0]}"), F.col(f"price_{periods[1]}")
    return o.finish(rows.withColumn("divergence", F.when((a * b < 0) & (F.abs(a) > 0.5) & (F.abs(b) > 0.5), F.abs(a - b)).otherwise(0.0)),
                    "symbol", "seq", *cols, "divergence")


def footprints(bars: DataFrame) -> DataFrame:
    """Footprint patterns of each bar as an array of (name, kind, direction, confidence), strongest first."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = bars.withColumns({
        "delta": F.col("buy_volume") - F.col("sell_volume"), "move": pct_change(F.col("close"), w) * 100,
        "imbalance": _balance(F.col("buy_volume"), F.col("sell_volume")), "avg_volume": rmean(F.col("volume"), w, 20, 1)})
    ratio = F.col("volume") / F.col("avg_volume")
    d, mv, im = F.col("delta"), F.col("move"), F.col("imbalance")
    absorbed = F.least(ratio / 2, F.lit(1.0))
    rules = [
        ("p_reversal", "reversal", "bullish", (absorbed > 0.7) & (d > 100) & (F.abs(mv) < 10), absorbed + 0.3),
        ("b_reversal", "reversal", "bearish", (d < -100) & (mv < -0.05) & (im < -0.3), F.abs(im * 2)),
        ("exhaustion", "exhaustion", "neutral", (ratio > 2) & (F.abs(mv) < 5), ratio / 2),
        ("initiative_buying", "continuation", "bullish", (d > 50) & (mv > 0.1), d / 100),
        ("initiative_selling", "continuation", "bearish", (d < -50) & (mv < -0.1), F.abs(d) / 100)]
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.round(F.least(F.lit(FOOTPRINT_BASE[n]) * c, F.lit(1.0)), 9).alias("confidence"), F.lit(n).alias("name"),
                              F.lit(kind).alias("kind"), F.lit(direction).alias("direction")))
        for n, kind, direction, cond, c in rules]))
    return t.withColumn("patterns", F.sort_array(found, asc=False))


def next_action(found: DataFrame) -> DataFrame:
    """Action, expected movement and confidence from the strongest footprint pattern."""
    top = F.get("patterns", F.lit(0))
    side = F.when(top.direction == "bullish", 1).otherwise(-1)
    size = F.when(top.kind == "reversal", 0.5).when(top.kind == "continuation", 0.3).otherwise(0.0)
    return found.withColumns({
        "action": F.when(top.isNull(), "hold").when(top.kind == "exhaustion", "wait").when(side > 0, "buy").otherwise("sell"),
        "expected": F.coalesce(size * side, F.lit(0.0)) + 0.0, "confidence": F.coalesce(top.confidence * 0.8, F.lit(0.0))})


def pattern_shares(found: DataFrame) -> DataFrame:
    per = found.select(F.explode("patterns").alias("p")).groupBy(F.col("p.name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    return per.crossJoin(F.broadcast(total)).select("name", "n", (F.col("n") / F.col("_all")).alias("share"))


def agents(ticks: DataFrame, top: int, inner: int, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Top-agent activity, changes, repeats, switch rate, institutional flow and diversity.

    The top agents are a reference set (``top`` rows); pass training rows only to avoid look-ahead.
    """
    t = ticks
    for col, side in (("buy_agent", "buyer"), ("sell_agent", "seller")):  # the inner set is the head of the ranked outer one
        ranked = top_values(ticks, col, max(top, inner)).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("n"), col)))
        t = t.join(small_side(ranked.select(F.col(col).alias("_m"), "_rank")), F.col(col) == F.col("_m"), "left")
        t = t.withColumns({f"{name}_{side}": F.coalesce((F.col("_rank") <= k).cast("int"), F.lit(0)) for name, k in (("top", top), ("inst", inner))}).drop("_m", "_rank")
    o = _layout(t, chunk_rows)
    w = o.window
    changed = lambda c: (~F.lag(c).over(w).eqNullSafe(F.col(c))).cast("int")
    rows = o.chunked(before=n).withColumns({"buyer_changed": changed("buy_agent"), "seller_changed": changed("sell_agent")})
    rows = rows.withColumns({
        "turnover": rmean((F.col("buyer_changed") + F.col("seller_changed")) / 2.0, w, n),
        "switch_rate": rmean(F.col("buyer_changed"), w, n),
        "institutional_flow": rsum(F.col("inst_buyer"), w, n) - rsum(F.col("inst_seller"), w, n),
        "buyer_diversity": F.when(F.count("buy_agent").over(o.last(n)) >= n, distinct_in(F.col("buy_agent"), o.last(n)))})
    out = o.running(rows, _from=("max", F.when(F.col("buyer_changed") == 1, F.col("_rn"))))
    return out.withColumn("buyer_repeats", F.col("_rn") - F.col("_from"))


def large_flow(ticks: DataFrame, rank_n: int, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Signed count of trades above the 95th rolling percentile of size, and price impact."""
    o = _layout(ticks, chunk_rows)
    w = o.window
    rows = o.chunked(before=rank_n + n + 1).withColumns({
        "size_rank": percentile_rank(F.col("quantity"), w, rank_n),
        "impact": F.abs(pct_change(F.col("price"), w)) / F.log1p("quantity")})
    big = _flag(F.col("size_rank") > 0.95)
    rows = rows.withColumn("_sb", big * (_buy(F.lit(1)) - _sell(F.lit(1))))
    return o.finish(rows.withColumns({"large_imbalance": rsum(F.col("_sb"), w, n), "impact_ma": rmean(F.col("impact"), w, n)}),
                    "symbol", "seq", "size_rank", "large_imbalance", "impact", "impact_ma")


def size_thresholds(ticks: DataFrame, probs: list[float]) -> DataFrame:
    """Exact size quantiles per symbol, as a small table to fit on training rows."""
    return exact_quantiles(ticks, ["symbol"], "quantity", {f"p{round(p * 100)}": p for p in probs})


def large_flags(ticks: DataFrame, thresholds: DataFrame, n: int, chunk_rows: int | None = None) -> DataFrame:
    """Flags above each fitted threshold and their share over the last n trades."""
    names = [c for c in thresholds.columns if c != "symbol"]
    o = _layout(ticks.join(small_side(thresholds), "symbol"), chunk_rows)
    flags = {f"large_{p}": (F.col("quantity") > F.col(p)).cast("int") for p in names}
    rows = o.chunked(before=n).withColumns(flags)
    return o.finish(rows.withColumns({f"{k}_share": rmean(F.col(k), o.window, n) for k in flags}))


def flow_alerts(bars: DataFrame, ofi: float, large: float, trades: int) -> DataFrame:
    """Bars that break a flow limit, with the list of broken rules."""
    t = bars.withColumns({"ofi": _balance(F.col("buy_volume"), F.col("sell_volume")),
                          "large_share": F.greatest("buy_volume", "sell_volume") / F.col("volume")})
    rules = F.array_compact(F.array(
        F.when(F.abs("ofi") > ofi, "ofi"), F.when(F.col("large_share") > large, "large"), F.when(F.col("trades") > trades, "speed")))
    return t.withColumn("alerts", rules).where(F.size("alerts") > 0)
