"""Technical indicators over bars.

Bars are bounded by the clock per symbol, so one exchange by symbol serves every window of a call.
Recurrences (EMA, Wilder) are scans of affine maps over chunks of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.ordered import lay_out
from tickloom.operators.scan import smooth
from tickloom.operators.windows import (
    clip, div, last_rows, pct_change, percentile_rank, rmax, rmean, rmedian, rmin, roll, rstd, rsum)


def _bar() -> tuple:
    """The window of a symbol's bars and the five bar columns."""
    return (Window.partitionBy("symbol").orderBy("ts"),
            *(F.col(c) for c in ("open", "high", "low", "close", "volume")))


def base(bars: DataFrame) -> DataFrame:
    """Bars with the differences that most indicators share."""
    W, O, H, L, C, V = _bar()
    pc = F.lag("close").over(W)
    return bars.withColumns({
        "pc": pc, "delta": C - pc, "ret": F.try_divide(C, pc) - 1,
        "gain": F.when(C > pc, C - pc).otherwise(0.0), "loss": F.when(C < pc, pc - C).otherwise(0.0),
        "tr": F.greatest(H - L, F.abs(H - pc), F.abs(L - pc)),
        "hd": H - F.lag("high").over(W), "ld": F.lag("low").over(W) - L})


def ema_set(bars: DataFrame, spans: list[int]) -> DataFrame:
    return smooth(bars.select("symbol", "ts", "close"), ["symbol"], "ts",
                  [(f"ema_{s}", "close", "ema", s) for s in spans])


def bands(bars: DataFrame) -> DataFrame:
    """Simple means, Bollinger bands, stochastics, Ichimoku conversion line."""
    W, O, H, L, C, V = _bar()
    b = bars
    for n in (10, 20, 50):
        b = b.withColumns({f"sma_{n}": rmean(C, W, n), f"std_{n}": rstd(C, W, n)})
    lo, hi = rmin(L, W, 14), rmax(H, W, 14)
    width = 4 * F.col("std_20")
    b = b.withColumns({
        "sma_10_open": rmean(C, W, 10, 1), "bb_width": width, "bb_width_10": 4 * F.col("std_10"),
        "bb_upper": F.col("sma_20") + 2 * F.col("std_20"), "bb_lower": F.col("sma_20") - 2 * F.col("std_20"),
        "bb_position": clip((C - (F.col("sma_20") - 2 * F.col("std_20"))) / F.when(width == 0, 1.0).otherwise(width), 0.0, 1.0),
        "stoch_k": 100 * (C - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo),
        "ichimoku": (rmax(H, W, 9) + rmin(L, W, 9)) / 2})
    b = b.withColumn("stoch_d", rmean(F.col("stoch_k"), W, 3)).withColumn("slow_d", rmean(F.col("stoch_d"), W, 3))
    return b.withColumns({
        "bb_squeeze": F.coalesce((F.col("bb_width") < rmean(F.col("bb_width"), W, 50)).cast("int"), F.lit(0)),
        "stoch_oversold": F.coalesce((F.col("stoch_k") < 20).cast("int"), F.lit(0)),
        "stoch_overbought": F.coalesce((F.col("stoch_k") > 80).cast("int"), F.lit(0))})


def rsi_from(gain: Column, loss: Column) -> Column:
    return 100 - 100 / (1 + gain / F.when(loss == 0, 1e-10).otherwise(loss))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Three variants: simple means, adjusted exponential means, Wilder smoothing."""
    W, _, _, _, _, _ = _bar()
    b = base(bars).withColumn("rsi_sma", rsi_from(rmean(F.col("gain"), W, n), rmean(F.col("loss"), W, n)))
    b = smooth(b.select("symbol", "ts", "gain", "loss", "rsi_sma"), ["symbol"], "ts", [
        ("eg", "gain", "ema_adjust", n), ("el", "loss", "ema_adjust", n),
        ("wg", "gain", "wilder", n), ("wl", "loss", "wilder", n)])
    return b.select(
        "symbol", "ts", "rsi_sma", (100 - 100 / (1 + F.col("eg") / (F.col("el") + 1e-10))).alias("rsi_ewm"),
        rsi_from(F.col("wg"), F.col("wl")).alias("rsi_wilder"),
        F.coalesce((F.col("rsi_sma") < 30).cast("int"), F.lit(0)).alias("oversold"),
        F.coalesce((F.col("rsi_sma") > 70).cast("int"), F.lit(0)).alias("overbought"))


def rsi_ticks(ticks: DataFrame, n: int = 14, chunk_rows: int | None = None) -> DataFrame:
    """RSI of tick returns, over chunks."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    w = o.window
    rows = o.chunked(before=n + 1).withColumn("_ret", pct_change(F.col("price"), w))
    up, down = F.greatest(F.col("_ret"), F.lit(0.0)), F.greatest(-F.col("_ret"), F.lit(0.0))
    rows = rows.withColumn("_g", rmean(F.when(F.col("_ret").isNotNull(), up), w, n)).withColumn(
        "_d", rmean(F.when(F.col("_ret").isNotNull(), down), w, n))
    return o.finish(rows.withColumn("rsi", rsi_from(F.col("_g"), F.col("_d"))), "symbol", "seq", "rsi")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    W, _, _, _, _, _ = _bar()
    m = smooth(bars.select("symbol", "ts", "close"), ["symbol"], "ts", [
        ("_f", "close", "ema", fast), ("_s", "close", "ema", slow),
        ("macd", F.col("_f") - F.col("_s"), "expr", 0), ("macd_signal", "macd", "ema", signal)])
    h = F.round(F.col("macd") - F.col("macd_signal"), 9)
    m = m.withColumn("macd_hist", h)
    before = F.lag("macd_hist").over(W)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return m.select("symbol", "ts", "macd", "macd_signal", "macd_hist",
                    flag((h > 0) & (before <= 0)).alias("bullish"), flag((h < 0) & (before >= 0)).alias("bearish"))


def atr(bars: DataFrame) -> DataFrame:
    W, _, _, _, C, _ = _bar()
    b = base(bars).withColumn("atr_sma", rmean(F.col("tr"), W, 14))
    b = smooth(b.select("symbol", "ts", "close", "tr", "atr_sma"), ["symbol"], "ts", [
        ("atr", "tr", "ema", 14), ("atr_20", "tr", "ema", 20), ("atr_wilder", "tr", "wilder", 14)])
    return b.withColumn("atr_pct", F.col("atr") / C * 100)


def _directional(plus: str, minus: str, smooth_range: str) -> Column:
    up, down = (100 * F.try_divide(F.col(c), F.col(smooth_range)) for c in (plus, minus))
    return 100 * F.try_divide(F.abs(up - down), up + down)


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average directional index by exponential, simple and Wilder smoothing."""
    W, _, _, _, _, _ = _bar()
    hd, ld = F.col("hd"), F.col("ld")
    up, down = F.greatest(hd, F.lit(0.0)), F.greatest(ld, F.lit(0.0))
    both = (up > 0) & (down > 0)
    b = base(bars).withColumns({
        "pe": F.when(hd.isNotNull(), F.when(both & (up < down), 0.0).otherwise(up)),
        "me": F.when(ld.isNotNull(), F.when(both & (down < up), 0.0).otherwise(down)),
        "pw": F.when((hd > ld) & (hd > 0), hd).otherwise(0.0),
        "mw": F.when((ld > hd) & (ld > 0), ld).otherwise(0.0)})
    a14 = rmean(F.col("tr"), W, n)
    b = b.withColumns({"plus_di_sma": 100 * rmean(F.col("pw"), W, n) / a14,
                       "minus_di_sma": 100 * rmean(F.col("mw"), W, n) / a14})
    b = b.withColumn("dx_sma", 100 * F.abs(F.col("plus_di_sma") - F.col("minus_di_sma"))
                     / (F.col("plus_di_sma") + F.col("minus_di_sma") + 1e-10))
    b = b.withColumn("adx_sma", rmean(F.col("dx_sma"), W, n))
    steps = [
        ("a", "tr", "ema", n), ("ps", "pe", "ema", n), ("ms", "me", "ema", n),
        ("wa", "tr", "wilder", n), ("wp", "pw", "wilder", n), ("wm", "mw", "wilder", n),
        ("dx", F.when(F.col("ps").isNotNull(), F.coalesce(_directional("ps", "ms", "a"), F.lit(0.0))), "expr", 0),
        ("wdx", _directional("wp", "wm", "wa"), "expr", 0),
        ("adx", "dx", "ema", n), ("adx_wilder", "wdx", "wilder_late", n)]
    out = smooth(b.select("symbol", "ts", "tr", "pe", "me", "pw", "mw", "adx_sma"), ["symbol"], "ts", steps)
    x = F.round("adx", 9)  # a full 100 belongs to the last class
    return out.select(
        "symbol", "ts", "adx", (100 * F.col("ps") / F.col("a")).alias("plus_di"),
        (100 * F.col("ms") / F.col("a")).alias("minus_di"), "adx_sma", "adx_wilder",
        F.when(x <= 0, None).when(x <= 25, "weak").when(x <= 50, "moderate").when(x <= 75, "strong")
        .when(x <= 100, "very_strong").alias("strength"))


def composite(bars: DataFrame) -> DataFrame:
    """EMA gaps, range share, volume ratio, short/long volatility, ADX substitute."""
    W, O, H, L, C, V = _bar()
    b = base(bars).withColumns({
        "range_pct": (H - L) / C * 100, "volume_ratio": div(V, rmean(V, W, 20)),
        "vol_ratio": div(rstd(F.col("ret"), W, 5), rstd(F.col("ret"), W, 20)),
        "adx_substitute": clip(rstd(F.col("ret"), W, 14) * 100, 0.0, 100.0)})
    b = smooth(b.select("symbol", "ts", "close", "range_pct", "volume_ratio", "vol_ratio", "adx_substitute"),
               ["symbol"], "ts", [(f"e{s}", "close", "ema", s) for s in (5, 9, 20)])
    return b.withColumns({"ema_diff": F.col("e9") - F.col("e20"), "ema_diff_fast": F.col("e5") - F.col("e9")})


def momentum(bars: DataFrame) -> DataFrame:
    W, _, _, _, C, _ = _bar()
    cols = {}
    for n in (1, 5, 20):
        before = F.lag(C, n).over(W)
        cols |= {f"momentum_{n}": C - before, f"roc_{n}": (C / before - 1) * 100, f"log_ret_{n}": F.log(C / before)}
    cols["acceleration"] = (C - F.lag(C, 5).over(W)) - (F.lag(C, 5).over(W) - F.lag(C, 10).over(W))
    return bars.withColumns(cols)


def adaptive_momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    """Momentum whose look-back is 0.7 n in high and 1.3 n in low volatility."""
    W, _, _, _, C, _ = _bar()
    b = bars.withColumn("_std", rstd(C, W, 20))
    b = b.withColumn("_rank", F.coalesce(percentile_rank(F.col("_std"), W, 50), F.lit(0.5)))
    hi, lo = F.lag(C, max(1, int(n * 0.7))).over(W), F.lag(C, int(n * 1.3)).over(W)
    m = C - F.when(F.col("_rank") > 0.67, hi).when(F.col("_rank") <= 0.33, lo).otherwise(F.lag(C, n).over(W))
    b = b.withColumn("momentum", F.when(F.row_number().over(W) > n, m))
    b = b.withColumns({
        "momentum_pct": div(F.col("momentum"), F.lag(C, n).over(W)) * 100,
        "momentum_smooth": rmean(F.col("momentum"), W, 3, 1),
        "momentum_rank": F.coalesce(percentile_rank(F.col("momentum"), W, 50), F.lit(0.5)),
        "reversal": F.coalesce((F.col("momentum") * F.lag("momentum").over(W) < 0).cast("int"), F.lit(0)),
        "divergence": F.coalesce(div(C - F.lag(C, 5).over(W), C - F.lag(C, 20).over(W)), F.lit(0.0)),
        "trend_consistency": sum((F.coalesce((C > F.lag(C, k).over(W)).cast("int"), F.lit(0)) for k in (5, 10, 20)), F.lit(0)) / 3.0})
    return b


def return_quality(bars: DataFrame, n: int = 20) -> DataFrame:
    W, _, _, _, C, V = _bar()
    b = bars.withColumn("ret_n", (C / F.lag(C, n).over(W) - 1) * 100)
    return b.withColumns({"ret_volume": F.col("ret_n") * F.coalesce(div(V, rmean(V, W, n)), F.lit(1.0)),
                          "ret_sharpe": F.coalesce(F.col("ret_n") / (rstd(F.col("ret_n"), W, 20) + 1e-10), F.lit(0.0))})


def on_balance(bars: DataFrame) -> DataFrame:
    W, _, _, _, _, V = _bar()
    up = W.rowsBetween(Window.unboundedPreceding, 0)
    b = base(bars)
    b = b.withColumns({"obv": F.sum(F.coalesce(V * F.signum("delta"), F.lit(0.0))).over(up), "pv": F.col("ret") * V})
    return b.withColumns({"obv_ma": rmean(F.col("obv"), W, 20), "obv_momentum": F.col("obv") - F.lag("obv", 10).over(W),
                          "pvt": rsum(F.col("pv"), W, 10)})


def volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close-to-close, Parkinson, Garman-Klass, Rogers-Satchell, range and semi volatilities."""
    W, O, H, L, C, V = _bar()
    year = math.sqrt(252)
    ho, lo, co, hl = F.log(H / O), F.log(L / O), F.log(C / O), F.log(H / L)
    ret = F.col("ret")
    b = base(bars).withColumns({
        "hl": hl, "hl2": hl * hl, "gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co,
        "rs": ho * (ho - co) + lo * (lo - co),
        "up": F.when(ret > 0, ret).otherwise(0.0), "down": F.when(ret < 0, ret).otherwise(0.0),
        "imb": F.abs(F.coalesce(div(F.col("buy_volume") - F.col("sell_volume"), F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0)))})
    top, bottom = rmax(H, W, n), rmin(L, W, n)
    b = b.withColumns({
        "vol_cc": rstd(ret, W, n) * year, "vol_parkinson": F.sqrt(rmean(F.col("hl2"), W, n) / (4 * math.log(2)) * 252),
        "vol_gk": F.sqrt(rmean(F.col("gk"), W, n) * 252), "vol_rs": F.sqrt(clip(rmean(F.col("rs"), W, n), 0.0)) * year,
        "vol_range": rstd(F.col("hl"), W, n) * year, "vol_up": rstd(F.col("up"), W, n) * year,
        "vol_down": rstd(F.col("down"), W, n) * year,
        "vol_imbalance": rstd(ret, W, n) * F.col("imb") / (rmean(F.col("imb"), W, n) + 1e-10) * year,
        "high_low_range": top - bottom, "range_pct": (top - bottom) / rmean(C, W, n) * 100,
        "to_high": (C - top) / C * 100, "to_low": (C - bottom) / C * 100,
        "price_position": (C - bottom) / (top - bottom + 1e-10)})
    return b.withColumn("vol_ratio", F.col("vol_up") / (F.col("vol_down") + 1e-10))


def vwap(bars: DataFrame, n: int = 20) -> DataFrame:
    W, O, H, L, C, V = _bar()
    typical, up = (H + L + C) / 3, W.rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumns({"vwap": F.sum(typical * V).over(last_rows(W, n)) / F.sum(V).over(last_rows(W, n)),
                          "vwap_all": F.sum(typical * V).over(up) / F.sum(V).over(up)})
    b = b.withColumn("vwap", F.when(F.count("vwap").over(last_rows(W, n)) >= n, F.col("vwap")))
    return b.withColumns({"to_vwap": (C / F.col("vwap") - 1) * 100,
                          "vwap_side": F.when(C > F.col("vwap"), 1).otherwise(-1)})


def pivots(bars: DataFrame, n: int = 20) -> DataFrame:
    W, O, H, L, C, V = _bar()
    p = (H + L + C) / 3
    r, s = rmax(H, W, n), rmin(L, W, n)
    return bars.withColumns({
        "pivot": p, "r1": 2 * p - L, "s1": 2 * p - H, "resistance": r, "support": s,
        "to_resistance": (r - C) / C * 100, "to_support": (C - s) / C * 100})


def candle_patterns(bars: DataFrame) -> DataFrame:
    W, O, H, L, C, V = _bar()
    body, prev = C - O, F.lag(C - O).over(W)
    po, pcl = F.lag(O).over(W), F.lag(C).over(W)
    upper, lower = H - F.greatest(O, C), F.least(O, C) - L
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return bars.withColumns({
        "doji": flag(F.abs(body) < (H - L) * 0.1), "hammer": flag((lower > F.abs(body) * 2) & (upper < F.abs(body) * 0.5)),
        "bullish_engulfing": flag((body > 0) & (prev < 0) & (C > po) & (O < pcl)),
        "bearish_engulfing": flag((body < 0) & (prev > 0) & (C < po) & (O > pcl))})


def entry_exit(bars: DataFrame, n: int = 5) -> DataFrame:
    """Swings (look ahead by n bars), breakouts, RSI divergence, climax, wicks, exhaustion."""
    W, O, H, L, C, V = _bar()
    b = base(bars).withColumn("rsi", rsi_from(rmean(F.col("gain"), W, 14), rmean(F.col("loss"), W, 14)))
    around = W.rowsBetween(-n, n)
    full = F.count(C).over(around) == 2 * n + 1
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    past = W.rowsBetween(-20, -1)
    past2 = W.rowsBetween(-21, -2)
    mom = lambda k: F.abs(C - F.lag(C, k).over(W))
    rng = F.nullif(H - L, F.lit(0.0))
    return b.withColumns({
        "swing_high": flag(full & (H == F.max(H).over(around))), "swing_low": flag(full & (L == F.min(L).over(around))),
        "breakout_up": flag((C > F.max(H).over(past)) & (F.lag(C).over(W) <= F.max(H).over(past2))),
        "breakout_down": flag((C < F.min(L).over(past)) & (F.lag(C).over(W) >= F.min(L).over(past2))),
        "bearish_divergence": flag((H == rmax(H, W, 14)) & ~(F.round("rsi", 9) == rmax(F.round("rsi", 9), W, 14))),
        "bullish_divergence": flag((L == rmin(L, W, 14)) & ~(F.round("rsi", 9) == rmin(F.round("rsi", 9), W, 14))),
        "volume_climax": flag(V > rmean(V, W, 20) + 2 * rstd(V, W, 20)),
        "upper_wick": F.coalesce((H - F.greatest(O, C)) / rng, F.lit(0.0)),
        "lower_wick": F.coalesce((F.least(O, C) - L) / rng, F.lit(0.0)),
        "exhaustion": flag((mom(5) < mom(10)) & (mom(10) < mom(20)))})


def composite_flags(bars: DataFrame) -> DataFrame:
    W, _, _, _, C, _ = _bar()
    b = base(bars).withColumns({
        "rsi": rsi_from(rmean(F.col("gain"), W, 14), rmean(F.col("loss"), W, 14)), "vol": rstd(F.col("ret"), W, 20)})
    b = smooth(b.select("symbol", "ts", "close", "rsi", "vol"), ["symbol"], "ts", [
        *[(f"e{s}", "close", "ema", s) for s in (9, 12, 20, 26, 50)],
        ("m", F.col("e12") - F.col("e26"), "expr", 0), ("sg", "m", "ema", 9)])
    above = lambda a, c: (F.round(a, 9) > F.round(c, 9)).cast("int")
    cross = F.when(F.round(F.col("m") - F.col("sg"), 9) > 0, 1).otherwise(-1)
    b = b.withColumn("macd_cross", cross)
    mom = lambda k: C - F.lag(C, k).over(W)
    e9, e20, e50 = F.col("e9"), F.col("e20"), F.col("e50")
    return b.select(
        "symbol", "ts", F.coalesce((F.col("rsi") < 30).cast("int"), F.lit(0)).alias("rsi_oversold"), "macd_cross",
        (F.col("macd_cross") - F.lag("macd_cross").over(W)).alias("macd_cross_change"),
        (above(e9, e20) + above(e20, e50) - 1).alias("ema_alignment"),
        ((above(C, e9) + above(C, e20) + above(C, e50)) / 3.0).alias("price_above_emas"),
        F.coalesce((F.col("vol") > 1.5 * rmedian(F.col("vol"), W, 100)).cast("int"), F.lit(0)).alias("high_volatility"),
        (mom(5) / C * 0.5 + mom(10) / C * 0.3 + mom(20) / C * 0.2).alias("momentum_strength"))


def lag_features(bars: DataFrame, cols: list[str], lags: list[int]) -> DataFrame:
    W, *_ = _bar()
    return bars.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(W) for c in cols for k in lags})


def volume_features(bars: DataFrame, n: int = 20) -> DataFrame:
    W, _, _, _, _, V = _bar()
    m, s = rmean(V, W, n), rstd(V, W, n)
    v = V.cast("double")
    return bars.withColumns({
        "volume_ma": m, "volume_ratio": V / (m + 1e-10), "volume_z": (V - m) / F.greatest(s, F.lit(0.001)),
        "volume_momentum": V - F.lag(V, n).over(W),
        "volume_hhi": rsum(v * v, W, n) / (rsum(v, W, n) * rsum(v, W, n) + 1e-10), "volume_cv": s / m})


def side_momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    """Close against the buy- and sell-volume-weighted mean closes."""
    W, _, _, _, C, _ = _bar()
    f = last_rows(W, n)
    full = F.count(C).over(f) >= n
    mean = lambda v: F.when(full, F.try_divide(F.sum(C * F.col(v)).over(f), F.sum(F.col(v)).over(f).cast("double")))
    buy, sell = mean("buy_volume"), mean("sell_volume")
    return bars.withColumns({"vw_buy": C - buy, "vw_sell": C - sell, "vw_diff": buy - sell})


def interactions(bars: DataFrame) -> DataFrame:
    W, _, _, _, C, V = _bar()
    b = base(bars)
    mom = (C / F.lag(C, 20).over(W) - 1) * 100
    vol = rstd(F.col("ret"), W, 20)
    imb = F.coalesce(div(F.col("buy_volume") - F.col("sell_volume"), F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0))
    z = (V - rmean(V, W, 20)) / F.greatest(rstd(V, W, 20), F.lit(0.001))
    return b.withColumns({"momentum_per_vol": mom / (vol + 1e-10), "volume_x_vol": z * vol, "pressure_x_momentum": imb * mom,
                          "trend_x_imbalance": F.signum(mom) * imb, "momentum_x_volume": mom * z})


def adaptive(bars: DataFrame) -> DataFrame:
    """RSI, ATR and band position whose period or width follows the volatility rank; regime ratios."""
    W, _, _, _, C, _ = _bar()
    b = base(bars).withColumn("std", rstd(C, W, 20))
    b = b.withColumn("rank", F.coalesce(percentile_rank(F.col("std"), W, 100), F.lit(0.5)))
    last25, last21 = last_rows(W, 25), last_rows(W, 21)
    pr = F.bround(5 + 20 * (1 - F.col("rank")), 0).cast("int")
    pa = F.bround(7 + 14 * (1 - F.col("rank")), 0).cast("int")
    b = b.withColumns({"_g": F.collect_list("gain").over(last25), "_d": F.collect_list("loss").over(last25),
                       "_t": F.collect_list("tr").over(last21), "_pr": pr, "_pa": pa, "_i": F.row_number().over(W)})
    tail_sum = lambda a, k: F.aggregate(F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k), F.lit(0.0), lambda s, x: s + x)
    g, d = tail_sum(F.col("_g"), F.col("_pr") - 1), tail_sum(F.col("_d"), F.col("_pr") - 1)
    b = b.withColumns({"_gs": g, "_ds": d, "_ts": tail_sum(F.col("_t"), F.col("_pa"))})
    rsi_now = F.when(F.col("_i") > F.col("_pr"), F.when(F.round("_ds", 9) > 0, 100 - 100 / (1 + F.col("_gs") / F.col("_ds")))
                     .when(F.round("_gs", 9) > 0, 100.0).otherwise(50.0))
    upto = W.rowsBetween(Window.unboundedPreceding, 0)
    mult = 1.5 + F.col("rank")
    sma20 = rmean(C, W, 20)
    b = b.withColumns({
        "_rsi": rsi_now, "adaptive_atr": F.when(F.col("_i") >= F.col("_pa"), F.col("_ts") / F.col("_pa")),
        "band_position": (C - (sma20 - mult * F.col("std"))) / F.nullif(2 * mult * F.col("std"), F.lit(0.0)),
        "volatility_regime": div(F.col("std"), rmean(F.col("std"), W, 50)),
        "price_position": (C - rmean(C, W, 50)) / rmean(C, W, 50), "_m10": C / F.lag(C, 10).over(W) - 1})
    return b.withColumns({"adaptive_rsi": F.last("_rsi", ignorenulls=True).over(upto),
                          "momentum_regime": rmean(F.col("_m10"), W, 20)})


def dynamic_macd(bars: DataFrame) -> DataFrame:
    """MACD with faster spans while volume runs above its mean; trend strength by volatility."""
    W, _, _, _, C, V = _bar()
    b = bars.withColumns({"busy": F.coalesce(div(rmean(V, W, 20), rmean(V, W, 50)), F.lit(1.0)) > 1.2,
                          "std": rstd(C, W, 20)})
    b = smooth(b.select("symbol", "ts", "close", "busy", "std"), ["symbol"], "ts",
               [(f"e{s}", "close", "ema", s) for s in (9, 10, 12, 20, 22, 26)])
    return b.select("symbol", "ts",
                    F.when(F.col("busy"), F.col("e10") - F.col("e22")).otherwise(F.col("e12") - F.col("e26")).alias("macd"),
                    div(F.col("e9") - F.col("e20"), F.col("std")).alias("trend_strength"))


def mean_deviation(bars: DataFrame) -> DataFrame:
    W, _, _, _, C, _ = _bar()
    dev = {f"dev_{n}": C / rmean(C, W, n) - 1 for n in (5, 10, 20)}
    fast = (rmean(C, W, 5) / rmean(C, W, 20) - 1) * 100
    slow = (rmean(C, W, 20) / rmean(C, W, 50) - 1) * 100
    return bars.withColumns(dev | {"ma_5_20": fast, "ma_20_50": slow, "ma_trend": fast + slow})


def support_resistance(bars: DataFrame, look_back: int = 50) -> DataFrame:
    """Nearest swing levels of the last bars; a swing counts once its two later bars are known."""
    W, O, H, L, C, V = _bar()
    around = W.rowsBetween(-2, 2)
    full = F.count(C).over(around) == 5
    b = bars.withColumns({"_r": F.when(full & (H == F.max(H).over(around)), H), "_s": F.when(full & (L == F.min(L).over(around)), L)})
    known = W.rowsBetween(-(look_back - 1), -2)
    b = b.withColumns({"_rs": F.collect_list("_r").over(known), "_ss": F.collect_list("_s").over(known)})
    res, sup = F.array_min(F.filter("_rs", lambda x: x > C)), F.array_max(F.filter("_ss", lambda x: x < C))
    b = b.withColumns({"level_above": res, "level_below": sup})
    above, below = F.coalesce("level_above", C * 1.01), F.coalesce("level_below", C * 0.99)
    ds, dr = (C - below) / C, (above - C) / C
    return b.withColumns({"resistance": above, "support": below, "to_resistance": dr, "to_support": ds,
                          "proximity": F.when(ds <= 0.002, "near_support").when(dr <= 0.002, "near_resistance").otherwise("neutral")})


def stops(bars: DataFrame, multiple: float = 2.0) -> DataFrame:
    """Long and short stop prices by ATR, by volatility and by support/resistance."""
    W, _, _, _, C, _ = _bar()
    b = support_resistance(base(bars))
    a, vol = rmean(F.col("tr"), W, 14), rstd(F.col("ret"), W, 20) * math.sqrt(30)
    return b.withColumns({
        "atr_long": C - multiple * a, "atr_short": C + multiple * a,
        "vol_long": C - C * vol * 2, "vol_short": C + C * vol * 2,
        "sr_long": F.coalesce(F.col("level_below") * 0.995, C * 0.98),
        "sr_short": F.coalesce(F.col("level_above") * 1.005, C * 1.02)})
