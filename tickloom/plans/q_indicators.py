"""Technical indicators on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import indicators as ti
from tickloom.plans import emasql as es
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import PART, W, flag, fr, high, lag, low, mean, rank, std, total


def out(df, cols, plain=(), digits=6):
    return df.select("symbol", "ts", *[rd(c, digits).alias(c) for c in cols], *plain)


SPANS = [5, 8, 9, 20, 26, 50, 200]


@query("t01_ema_set", "SELECT symbol, ts, " + ", ".join(f"{r(es.ema('close', s))} AS ema_{s}" for s in SPANS) + " FROM barx")
def _(spark, sf):
    return out(ti.ema_set(v.bars(spark, sf), SPANS), [f"ema_{s}" for s in SPANS])


@query("t02_t05_t06_t10_bands", f"""
WITH a AS (SELECT *, {mean("close", 20)} AS sma_20, {std("close", 20)} AS s20, {std("close", 10)} AS s10,
  {low("low", 14)} AS lo, {high("high", 14)} AS hi FROM bars),
b AS (SELECT *, 100 * (close - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS k, 4 * s20 AS bw FROM a),
c AS (SELECT *, {mean("k", 3)} AS d FROM b)
SELECT symbol, ts, {r(mean("close", 10))} AS sma_10, {r("sma_20")} AS sma_20, {r(mean("close", 50))} AS sma_50,
 {r(mean("close", 10, 1))} AS sma_10_open, {r("sma_20 + 2 * s20")} AS bb_upper, {r("sma_20 - 2 * s20")} AS bb_lower, {r("bw")} AS bb_width,
 {r("4 * s10")} AS bb_width_10, {r("CASE WHEN bw IS NOT NULL THEN least(greatest((close - (sma_20 - 2 * s20)) / (CASE WHEN bw = 0 THEN 1 ELSE bw END), 0), 1) END")} AS bb_position,
 {r("k")} AS stoch_k, {r("d")} AS stoch_d, {r(mean("d", 3))} AS slow_d, {r(f"({high('high', 9)} + {low('low', 9)}) / 2")} AS ichimoku,
 {flag(f"bw < {mean('bw', 50)}")} AS bb_squeeze, {flag("k < 20")} AS stoch_oversold, {flag("k > 80")} AS stoch_overbought FROM c""")
def _(spark, sf):
    b = ti.bands(v.bars(spark, sf))
    return out(b, ["sma_10", "sma_20", "sma_50", "sma_10_open", "bb_upper", "bb_lower", "bb_width", "bb_width_10", "bb_position",
                   "stoch_k", "stoch_d", "slow_d", "ichimoku"], ["bb_squeeze", "stoch_oversold", "stoch_overbought"])


def _rsi(g, l):
    return f"100 - 100 / (1 + ({g}) / (CASE WHEN ({l}) = 0 THEN 1e-10 ELSE ({l}) END))"


@query("t03_rsi_variants", f"""
WITH s AS (SELECT *, avg(CASE WHEN rn <= 14 THEN gain END) OVER (PARTITION BY symbol) AS sg, avg(CASE WHEN rn <= 14 THEN loss END) OVER (PARTITION BY symbol) AS sl FROM barx),
a AS (SELECT symbol, ts, rn, {mean("gain", 14)} AS g, {mean("loss", 14)} AS l, {es.ema_adjusted("gain", 14)} AS eg, {es.ema_adjusted("loss", 14)} AS el,
 {es.wilder("gain", 14, "rn", "sg")} AS wg, {es.wilder("loss", 14, "rn", "sl")} AS wl FROM s)
SELECT symbol, ts, {r(_rsi("g", "l"))} AS rsi_sma, {r("CASE WHEN rn >= 14 THEN 100 - 100 / (1 + eg / (el + 1e-10)) END")} AS rsi_ewm,
 {r(_rsi("wg", "wl"))} AS rsi_wilder, {flag(f"{_rsi('g', 'l')} < 30")} AS oversold, {flag(f"{_rsi('g', 'l')} > 70")} AS overbought FROM a""")
def _(spark, sf):
    return out(ti.rsi(v.bars(spark, sf)), ["rsi_sma", "rsi_ewm", "rsi_wilder"], ["oversold", "overbought"])


TP = "PARTITION BY symbol ORDER BY ts, seq"


@query("t03_rsi_ticks", f"""
WITH a AS (SELECT *, price / lag(price) OVER ({TP}) - 1 AS ret FROM ticks),
b AS (SELECT *, CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) END AS g, CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0) END AS l FROM a),
c AS (SELECT symbol, seq, {mean("g", 14, part=TP)} AS g, {mean("l", 14, part=TP)} AS l FROM b)
SELECT symbol, seq, {r(_rsi("g", "l"))} AS rsi FROM c""")
def _(spark, sf):
    return ti.rsi_ticks(v.ticks(spark, sf)).withColumn("rsi", rd("rsi"))


@query("t04_macd", f"""
WITH a AS (SELECT symbol, ts, rn, {es.ema("close", 12)} - {es.ema("close", 26)} AS m FROM barx),
b AS (SELECT *, {es.ema("m", 9)} AS sg FROM a), c AS (SELECT *, round(m - sg, 9) AS h FROM b)
SELECT symbol, ts, {r("m")} AS macd, {r("sg")} AS macd_signal, {r("h")} AS macd_hist, {flag(f"h > 0 AND {lag('h')} <= 0")} AS bullish,
 {flag(f"h < 0 AND {lag('h')} >= 0")} AS bearish FROM c""")
def _(spark, sf):
    return out(ti.macd(v.bars(spark, sf)), ["macd", "macd_signal", "macd_hist"], ["bullish", "bearish"])


@query("t07_atr", f"""
WITH s AS (SELECT *, avg(CASE WHEN rn <= 14 THEN tr END) OVER (PARTITION BY symbol) AS seed FROM barx)
SELECT symbol, ts, {r("tr")} AS tr, {r(es.ema("tr", 14))} AS atr, {r(es.ema("tr", 20))} AS atr_20, {r(mean("tr", 14))} AS atr_sma,
 {r(es.wilder("tr", 14, "rn", "seed"))} AS atr_wilder, {r(es.ema("tr", 14) + " / close * 100")} AS atr_pct FROM s""")
def _(spark, sf):
    return out(ti.atr(v.bars(spark, sf)), ["tr", "atr", "atr_20", "atr_sma", "atr_wilder", "atr_pct"])


@query("t08_adx", f"""
WITH a AS (SELECT *, CASE WHEN hd IS NULL THEN NULL WHEN hd > 0 AND ld > 0 AND hd < ld THEN 0 ELSE greatest(hd, 0) END AS pe,
 CASE WHEN ld IS NULL THEN NULL WHEN hd > 0 AND ld > 0 AND ld < hd THEN 0 ELSE greatest(ld, 0) END AS me,
 CASE WHEN hd > ld AND hd > 0 THEN hd ELSE 0 END AS pw, CASE WHEN ld > hd AND ld > 0 THEN ld ELSE 0 END AS mw FROM barx),
s AS (SELECT *, avg(CASE WHEN rn <= 14 THEN tr END) OVER p AS st, avg(CASE WHEN rn <= 14 THEN pw END) OVER p AS sp, avg(CASE WHEN rn <= 14 THEN mw END) OVER p AS sm FROM a WINDOW p AS (PARTITION BY symbol)),
e AS (SELECT *, {es.ema("tr", 14)} AS ta, {es.ema("pe", 14, "(rn - 1)")} AS ps, {es.ema("me", 14, "(rn - 1)")} AS ms,
 {es.wilder("tr", 14, "rn", "st")} AS wa, {es.wilder("pw", 14, "rn", "sp")} AS wp, {es.wilder("mw", 14, "rn", "sm")} AS wm,
 {mean("tr", 14)} AS sa, {mean("pw", 14)} AS pa, {mean("mw", 14)} AS ma FROM s),
d AS (SELECT *, 100 * ps / ta AS pdi, 100 * ms / ta AS mdi, CASE WHEN rn > 1 THEN coalesce(100 * abs(ps - ms) / nullif(ps + ms, 0), 0) END AS dx,
 100 * abs(wp - wm) / nullif(wp + wm, 0) AS wdx, 100 * abs(100 * pa / sa - 100 * ma / sa) / (100 * pa / sa + 100 * ma / sa + 1e-10) AS sdx FROM e),
f AS (SELECT *, {es.ema("dx", 14, "(rn - 1)")} AS adx, {mean("sdx", 14)} AS adx_sma, {mean("wdx", 14, 1)} AS wseed FROM d),
g AS (SELECT *, CASE WHEN rn <= 28 THEN wseed ELSE {es.ema("(CASE WHEN rn = 28 THEN wseed ELSE wdx END)", 0, "(rn - 27)", alpha=1 / 14)} END AS adx_wilder FROM f)
SELECT symbol, ts, {r("adx")} AS adx, {r("pdi")} AS plus_di, {r("mdi")} AS minus_di, {r("adx_sma")} AS adx_sma, {r("adx_wilder")} AS adx_wilder,
 CASE WHEN round(adx, 9) <= 0 THEN NULL WHEN round(adx, 9) <= 25 THEN 'weak' WHEN round(adx, 9) <= 50 THEN 'moderate' WHEN round(adx, 9) <= 75 THEN 'strong' WHEN round(adx, 9) <= 100 THEN 'very_strong' END AS strength FROM g""")
def _(spark, sf):
    return out(ti.adx(v.bars(spark, sf)), ["adx", "plus_di", "minus_di", "adx_sma", "adx_wilder"], ["strength"])


@query("t09_composite", f"""
SELECT symbol, ts, {r("(high - low) / close * 100")} AS range_pct, {r("volume / " + mean("volume", 20))} AS volume_ratio,
 {r(f"{std('ret', 5)} / nullif({std('ret', 20)}, 0)")} AS vol_ratio, {r(f"CASE WHEN {std('ret', 14)} IS NOT NULL THEN least(greatest({std('ret', 14)} * 100, 0), 100) END")} AS adx_substitute,
 {r(f"{es.ema('close', 9)} - {es.ema('close', 20)}")} AS ema_diff, {r(f"{es.ema('close', 5)} - {es.ema('close', 9)}")} AS ema_diff_fast FROM barx""")
def _(spark, sf):
    b = ti.composite(v.bars(spark, sf))
    return out(b,
               ["range_pct", "volume_ratio", "vol_ratio", "adx_substitute", "ema_diff", "ema_diff_fast"])


@query("t11_momentum", "SELECT symbol, ts, " + ", ".join(
    f"{r('close - ' + lag('close', n))} AS momentum_{n}, {r(f'(close / {lag('close', n)} - 1) * 100')} AS roc_{n}, {r(f'ln(close / {lag('close', n)})')} AS log_ret_{n}"
    for n in (1, 5, 20)) + f", {r(f'close - 2 * {lag('close', 5)} + {lag('close', 10)}')} AS acceleration FROM bars")
def _(spark, sf):
    return out(ti.momentum(v.bars(spark, sf)), [f"{c}_{n}" for n in (1, 5, 20) for c in ("momentum", "roc", "log_ret")] + ["acceleration"])


@query("t12_adaptive_momentum", f"""
WITH a AS (SELECT *, {std("close", 20)} AS s FROM barx), b AS (SELECT *, list(s) FILTER (s IS NOT NULL) OVER {fr(50)} AS l FROM a),
c AS (SELECT *, coalesce({rank("s", "l", 50)}, 0.5) AS rk FROM b),
d AS (SELECT *, CASE WHEN rn > 10 THEN close - CASE WHEN rk > 0.67 THEN {lag("close", 7)} WHEN rk <= 0.33 THEN {lag("close", 13)} ELSE {lag("close", 10)} END END AS m FROM c),
e AS (SELECT *, list(m) FILTER (m IS NOT NULL) OVER {fr(50)} AS ml FROM d)
SELECT symbol, ts, {r("m")} AS momentum, {r("m / " + lag("close", 10) + " * 100")} AS momentum_pct, {r(mean("m", 3, 1))} AS momentum_smooth,
 {r(f"coalesce({rank('m', 'ml', 50)}, 0.5)")} AS momentum_rank, {flag(f"m * {lag('m')} < 0")} AS reversal,
 {r(f"coalesce((close - {lag('close', 5)}) / nullif(close - {lag('close', 20)}, 0), 0)")} AS divergence,
 {r(f"({flag('close > ' + lag('close', 5))} + {flag('close > ' + lag('close', 10))} + {flag('close > ' + lag('close', 20))}) / 3.0")} AS trend_consistency FROM e""")
def _(spark, sf):
    return out(ti.adaptive_momentum(v.bars(spark, sf)), ["momentum", "momentum_pct", "momentum_smooth", "momentum_rank", "divergence",
                                                         "trend_consistency"], ["reversal"])


@query("t13_return_quality", f"""
WITH a AS (SELECT *, (close / {lag("close", 20)} - 1) * 100 AS rn20 FROM bars)
SELECT symbol, ts, {r("rn20")} AS ret_n, {r(f"rn20 * coalesce(volume / {mean('volume', 20)}, 1)")} AS ret_volume,
 {r(f"coalesce(rn20 / ({std('rn20', 20)} + 1e-10), 0)")} AS ret_sharpe FROM a""")
def _(spark, sf):
    return out(ti.return_quality(v.bars(spark, sf)), ["ret_n", "ret_volume", "ret_sharpe"])


@query("t14_on_balance", f"""
WITH a AS (SELECT *, sum(coalesce(volume * sign(delta), 0)) OVER {W} AS o, ret * volume AS pv FROM barx)
SELECT symbol, ts, {r("o")} AS obv, {r(mean("o", 20))} AS obv_ma, {r("o - " + lag("o", 10))} AS obv_momentum, {r(total("pv", 10))} AS pvt FROM a""")
def _(spark, sf):
    return out(ti.on_balance(v.bars(spark, sf)), ["obv", "obv_ma", "obv_momentum", "pvt"])


Y = "sqrt(252.0::DOUBLE)"


@query("t15_t20_volatility", f"""
WITH a AS (SELECT *, ln(high / low) AS hl, pow(ln(high / low), 2) AS hl2, 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2) AS gk,
 ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs,
 CASE WHEN ret > 0 THEN ret ELSE 0 END AS up, CASE WHEN ret < 0 THEN ret ELSE 0 END AS down,
 abs(coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 0)) AS imb FROM barx),
b AS (SELECT *, {high("high", 20)} AS t, {low("low", 20)} AS bt, {std("up", 20)} * {Y} AS vu, {std("down", 20)} * {Y} AS vd FROM a)
SELECT symbol, ts, {r(f"{std('ret', 20)} * {Y}")} AS vol_cc, {r(f"sqrt({mean('hl2', 20)} / (4 * ln(2.0::DOUBLE)) * 252)")} AS vol_parkinson,
 {r(f"sqrt({mean('gk', 20)} * 252)")} AS vol_gk, {r(f"CASE WHEN {mean('rs', 20)} IS NOT NULL THEN sqrt(greatest({mean('rs', 20)}, 0)) * {Y} END")} AS vol_rs, {r(f"{std('hl', 20)} * {Y}")} AS vol_range,
 {r("vu")} AS vol_up, {r("vd")} AS vol_down, {r("vu / (vd + 1e-10)")} AS vol_ratio, {r(f"{std('ret', 20)} * imb / ({mean('imb', 20)} + 1e-10) * {Y}")} AS vol_imbalance,
 {r("t - bt")} AS high_low_range, {r(f"(t - bt) / {mean('close', 20)} * 100")} AS range_pct, {r("(close - t) / close * 100")} AS to_high,
 {r("(close - bt) / close * 100")} AS to_low, {r("(close - bt) / (t - bt + 1e-10)")} AS price_position FROM b""")
def _(spark, sf):
    b = ti.volatility(v.bars(spark, sf))
    return out(b, ["vol_cc", "vol_parkinson", "vol_gk", "vol_rs", "vol_range", "vol_up", "vol_down", "vol_ratio", "vol_imbalance",
                   "high_low_range", "range_pct", "to_high", "to_low", "price_position"])


@query("t21_vwap", f"""
WITH a AS (SELECT *, (high + low + close) / 3 * volume AS tv FROM bars),
b AS (SELECT *, CASE WHEN count(*) OVER {fr(20)} >= 20 THEN sum(tv) OVER {fr(20)} / sum(volume) OVER {fr(20)} END AS vw, sum(tv) OVER {W} / sum(volume) OVER {W} AS va FROM a)
SELECT symbol, ts, {r("vw")} AS vwap, {r("va")} AS vwap_all, {r("(close / vw - 1) * 100")} AS to_vwap, CASE WHEN close > vw THEN 1 ELSE -1 END AS vwap_side FROM b""")
def _(spark, sf):
    return out(ti.vwap(v.bars(spark, sf)), ["vwap", "vwap_all", "to_vwap"], ["vwap_side"])


@query("t22_pivots", f"""
WITH a AS (SELECT *, (high + low + close) / 3 AS p, {high("high", 20)} AS res, {low("low", 20)} AS sup FROM bars)
SELECT symbol, ts, {r("p")} AS pivot, {r("2 * p - low")} AS r1, {r("2 * p - high")} AS s1, res AS resistance, sup AS support,
 {r("(res - close) / close * 100")} AS to_resistance, {r("(close - sup) / close * 100")} AS to_support FROM a""")
def _(spark, sf):
    return out(ti.pivots(v.bars(spark, sf)), ["pivot", "r1", "s1", "to_resistance", "to_support"], ["resistance", "support"])


@query("t23_candle_patterns", f"""
WITH a AS (SELECT *, close - open AS body, {lag("open")} AS po, {lag("close")} AS pcl, high - greatest(open, close) AS u, least(open, close) - low AS l FROM bars)
SELECT symbol, ts, {flag("abs(body) < (high - low) * 0.1::DOUBLE")} AS doji, {flag("l > abs(body) * 2 AND u < abs(body) * 0.5::DOUBLE")} AS hammer,
 {flag("body > 0 AND pcl - po < 0 AND close > po AND open < pcl")} AS bullish_engulfing,
 {flag("body < 0 AND pcl - po > 0 AND close < po AND open > pcl")} AS bearish_engulfing FROM a""")
def _(spark, sf):
    return ti.candle_patterns(v.bars(spark, sf)).select("symbol", "ts", "doji", "hammer", "bullish_engulfing", "bearish_engulfing")


AROUND = f"({PART} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
PAST = f"({PART} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
PAST2 = f"({PART} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)"


@query("t24_entry_exit", f"""
WITH a AS (SELECT *, round({_rsi(mean("gain", 14), mean("loss", 14))}, 9) AS rsi, {mean("volume", 20)} AS vm, {std("volume", 20)} AS vs FROM barx)
SELECT symbol, ts, {flag(f"count(*) OVER {AROUND} = 11 AND high = max(high) OVER {AROUND}")} AS swing_high,
 {flag(f"count(*) OVER {AROUND} = 11 AND low = min(low) OVER {AROUND}")} AS swing_low,
 {flag(f"close > max(high) OVER {PAST} AND pc <= max(high) OVER {PAST2}")} AS breakout_up,
 {flag(f"close < min(low) OVER {PAST} AND pc >= min(low) OVER {PAST2}")} AS breakout_down,
 {flag(f"high = {high('high', 14)} AND NOT (rsi = {high('rsi', 14)})")} AS bearish_divergence,
 {flag(f"low = {low('low', 14)} AND NOT (rsi = {low('rsi', 14)})")} AS bullish_divergence, {flag("volume > vm + 2 * vs")} AS volume_climax,
 {r("coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)")} AS upper_wick, {r("coalesce((least(open, close) - low) / nullif(high - low, 0), 0)")} AS lower_wick,
 {flag(f"abs(close - {lag('close', 5)}) < abs(close - {lag('close', 10)}) AND abs(close - {lag('close', 10)}) < abs(close - {lag('close', 20)})")} AS exhaustion FROM a""")
def _(spark, sf):
    return out(ti.entry_exit(v.bars(spark, sf)), ["upper_wick", "lower_wick"], [
        "swing_high", "swing_low", "breakout_up", "breakout_down", "bearish_divergence", "bullish_divergence", "volume_climax", "exhaustion"])


@query("t25_composite_flags", f"""
WITH a AS (SELECT *, {_rsi(mean("gain", 14), mean("loss", 14))} AS rsi, {std("ret", 20)} AS vol, {es.ema("close", 9)} AS e9, {es.ema("close", 20)} AS e20, {es.ema("close", 50)} AS e50,
 {es.ema("close", 12)} - {es.ema("close", 26)} AS m FROM barx),
b AS (SELECT *, CASE WHEN round(m - {es.ema("m", 9)}, 9) > 0 THEN 1 ELSE -1 END AS mc FROM a)
SELECT symbol, ts, {flag("rsi < 30")} AS rsi_oversold, mc AS macd_cross, mc - {lag("mc")} AS macd_cross_change,
 {flag("round(e9, 9) > round(e20, 9)")} + {flag("round(e20, 9) > round(e50, 9)")} - 1 AS ema_alignment,
 {r(f"({flag('close > round(e9, 9)')} + {flag('close > round(e20, 9)')} + {flag('close > round(e50, 9)')}) / 3.0")} AS price_above_emas,
 {flag(f"vol > 1.5 * (CASE WHEN count(vol) OVER {fr(100)} >= 100 THEN quantile_cont(vol, 0.5) OVER {fr(100)} END)")} AS high_volatility,
 {r(f"(close - {lag('close', 5)}) / close * 0.5 + (close - {lag('close', 10)}) / close * 0.3 + (close - {lag('close', 20)}) / close * 0.2")} AS momentum_strength FROM b""")
def _(spark, sf):
    return out(ti.composite_flags(v.bars(spark, sf)), ["price_above_emas", "momentum_strength"],
               ["rsi_oversold", "macd_cross", "macd_cross_change", "ema_alignment", "high_volatility"])


@query("t26_lag_features", "SELECT symbol, ts, " + ", ".join(
    f"{lag(c, k)} AS {c}_lag_{k}" for c in ("close", "open") for k in (1, 5, 10, 20)) + " FROM bars")
def _(spark, sf):
    b = ti.lag_features(v.bars(spark, sf), ["close", "open"], [1, 5, 10, 20])
    return b.select("symbol", "ts", *[f"{c}_lag_{k}" for c in ("close", "open") for k in (1, 5, 10, 20)])


IMB = "coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 0)"


@query("t27_interactions", f"""
WITH a AS (SELECT *, (close / {lag("close", 20)} - 1) * 100 AS m, {std("ret", 20)} AS vol, {IMB} AS imb,
 (volume - {mean("volume", 20)}) / greatest({std("volume", 20)}, 0.001) AS z FROM barx)
SELECT symbol, ts, {r("m / (vol + 1e-10)", 5)} AS momentum_per_vol, {r("z * vol")} AS volume_x_vol, {r("imb * m")} AS pressure_x_momentum,
 {r("sign(m) * imb")} AS trend_x_imbalance, {r("m * z")} AS momentum_x_volume FROM a""")
def _(spark, sf):
    return out(ti.interactions(v.bars(spark, sf)).withColumn("momentum_per_vol", rd("momentum_per_vol", 5)), [
        "momentum_per_vol", "volume_x_vol", "pressure_x_momentum", "trend_x_imbalance", "momentum_x_volume"])


@query("t28_volume_features", f"""
WITH a AS (SELECT *, {mean("volume", 20)} AS m, {std("volume", 20)} AS s, volume::DOUBLE * volume AS v2 FROM bars)
SELECT symbol, ts, {r("m")} AS volume_ma, {r("volume / (m + 1e-10)")} AS volume_ratio, {r("CASE WHEN m IS NOT NULL THEN (volume - m) / greatest(s, 0.001) END")} AS volume_z,
 {r("volume - " + lag("volume", 20))} AS volume_momentum, {r(f"{total('v2', 20)} / (pow({total('volume', 20)}::DOUBLE, 2) + 1e-10)")} AS volume_hhi, {r("s / m")} AS volume_cv FROM a""")
def _(spark, sf):
    return out(ti.volume_features(v.bars(spark, sf)), ["volume_ma", "volume_ratio", "volume_z", "volume_momentum", "volume_hhi", "volume_cv"])


@query("t29_side_momentum", f"""
WITH a AS (SELECT *, close * buy_volume AS cb, close * sell_volume AS cs FROM bars),
b AS (SELECT *, CASE WHEN count(*) OVER {fr(10)} >= 10 THEN sum(cb) OVER {fr(10)} / nullif(sum(buy_volume) OVER {fr(10)}, 0) END AS vb,
 CASE WHEN count(*) OVER {fr(10)} >= 10 THEN sum(cs) OVER {fr(10)} / nullif(sum(sell_volume) OVER {fr(10)}, 0) END AS vs FROM a)
SELECT symbol, ts, {r("close - vb")} AS vw_buy, {r("close - vs")} AS vw_sell, {r("vb - vs")} AS vw_diff FROM b""")
def _(spark, sf):
    return out(ti.side_momentum(v.bars(spark, sf)), ["vw_buy", "vw_sell", "vw_diff"])


@query("t30_t31_adaptive", f"""
WITH a AS (SELECT *, {std("close", 20)} AS s, list(gain) OVER {fr(25)} AS gl, list(loss) OVER {fr(25)} AS ll, list(tr) OVER {fr(21)} AS tl, {mean("close", 20)} AS m20,
  {mean("close", 50)} AS m50, close / {lag("close", 10)} - 1 AS m10 FROM barx),
b AS (SELECT *, list(s) FILTER (s IS NOT NULL) OVER {fr(100)} AS sl FROM a),
c AS (SELECT *, coalesce({rank("s", "sl", 100)}, 0.5::DOUBLE) AS rk FROM b),
d AS (SELECT *, CAST(round_even(5 + 20 * (1 - rk), 0) AS INT) AS pr, CAST(round_even(7 + 14 * (1 - rk), 0) AS INT) AS pa FROM c),
e AS (SELECT *, coalesce(list_sum(gl[greatest(len(gl) - pr + 2, 1):]), 0) AS gs, coalesce(list_sum(ll[greatest(len(ll) - pr + 2, 1):]), 0) AS ds, list_sum(tl[greatest(len(tl) - pa + 1, 1):]) AS tsum FROM d),
f AS (SELECT *, CASE WHEN rn > pr THEN CASE WHEN round(ds, 9) > 0 THEN 100 - 100 / (1 + gs / ds) WHEN round(gs, 9) > 0 THEN 100 ELSE 50 END END AS rs FROM e)
SELECT symbol, ts, {r("last_value(rs IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")} AS adaptive_rsi,
 {r("CASE WHEN rn >= pa THEN tsum / pa END")} AS adaptive_atr, {r("(close - (m20 - (1.5 + rk) * s)) / nullif(2 * (1.5 + rk) * s, 0)")} AS band_position,
 {r("s / " + mean("s", 50))} AS volatility_regime, {r("(close - m50) / m50")} AS price_position, {r(mean("m10", 20))} AS momentum_regime FROM f""")
def _(spark, sf):
    return out(ti.adaptive(v.bars(spark, sf)), ["adaptive_rsi", "adaptive_atr", "band_position", "volatility_regime", "price_position", "momentum_regime"])


@query("t31_dynamic_macd", f"""
WITH a AS (SELECT *, coalesce({mean("volume", 20)} / {mean("volume", 50)}, 1) > 1.2 AS busy, {std("close", 20)} AS s FROM barx)
SELECT symbol, ts, {r(f"CASE WHEN busy THEN {es.ema('close', 10)} - {es.ema('close', 22)} ELSE {es.ema('close', 12)} - {es.ema('close', 26)} END")} AS macd,
 {r(f"({es.ema('close', 9)} - {es.ema('close', 20)}) / s")} AS trend_strength FROM a""")
def _(spark, sf):
    return out(ti.dynamic_macd(v.bars(spark, sf)), ["macd", "trend_strength"])


LEVELS = f"""
WITH a AS (SELECT *, CASE WHEN count(*) OVER c = 5 AND high = max(high) OVER c THEN high END AS rl, CASE WHEN count(*) OVER c = 5 AND low = min(low) OVER c THEN low END AS sl
  FROM barx WINDOW c AS ({PART} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
b AS (SELECT *, list(rl) OVER k AS rs, list(sl) OVER k AS ss FROM a WINDOW k AS ({PART} ROWS BETWEEN 49 PRECEDING AND 2 PRECEDING)),
c AS (SELECT *, list_min(list_filter(rs, lambda x: x > close)) AS la, list_max(list_filter(ss, lambda x: x < close)) AS lb FROM b)
"""


@query("t33_stops", LEVELS + f"""
SELECT symbol, ts, {r(f"close - 2 * {mean('tr', 14)}")} AS atr_long, {r(f"close + 2 * {mean('tr', 14)}")} AS atr_short,
 {r(f"close - close * {std('ret', 20)} * sqrt(30.0::DOUBLE) * 2")} AS vol_long, {r(f"close + close * {std('ret', 20)} * sqrt(30.0::DOUBLE) * 2")} AS vol_short,
 {r("coalesce(lb * 0.995, close * 0.98)")} AS sr_long, {r("coalesce(la * 1.005, close * 1.02)")} AS sr_short FROM c""")
def _(spark, sf):
    return out(ti.stops(v.bars(spark, sf)), ["atr_long", "atr_short", "vol_long", "vol_short", "sr_long", "sr_short"])


@query("r09_support_resistance", LEVELS + f"""
, d AS (SELECT *, coalesce(la, close * 1.01) AS res, coalesce(lb, close * 0.99) AS sup FROM c)
SELECT symbol, ts, {r("res")} AS resistance, {r("sup")} AS support, {r("(res - close) / close")} AS to_resistance, {r("(close - sup) / close")} AS to_support,
 CASE WHEN (close - sup) / close <= 0.002 THEN 'near_support' WHEN (res - close) / close <= 0.002 THEN 'near_resistance' ELSE 'neutral' END AS proximity FROM d""")
def _(spark, sf):
    return out(ti.support_resistance(v.bars(spark, sf)), ["resistance", "support", "to_resistance", "to_support"], ["proximity"])


@query("t34_mean_deviation", f"""
SELECT symbol, ts, {r(f"close / {mean('close', 5)} - 1")} AS dev_5, {r(f"close / {mean('close', 10)} - 1")} AS dev_10, {r(f"close / {mean('close', 20)} - 1")} AS dev_20,
 {r(f"({mean('close', 5)} / {mean('close', 20)} - 1) * 100")} AS ma_5_20, {r(f"({mean('close', 20)} / {mean('close', 50)} - 1) * 100")} AS ma_20_50,
 {r(f"({mean('close', 5)} / {mean('close', 20)} - 1) * 100 + ({mean('close', 20)} / {mean('close', 50)} - 1) * 100")} AS ma_trend FROM bars""")
def _(spark, sf):
    return out(ti.mean_deviation(v.bars(spark, sf)), ["dev_5", "dev_10", "dev_20", "ma_5_20", "ma_20_50", "ma_trend"])
