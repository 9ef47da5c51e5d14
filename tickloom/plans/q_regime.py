"""Regimes (R01-R10) and history comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import history as hi, regime as rg
from tickloom.plans import emasql as es
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import PART, W, flag, fr, lag, mean, std

TREND = f"""
WITH a0 AS (SELECT *, CASE WHEN hd > ld AND hd > 0 THEN hd ELSE 0 END AS pw, CASE WHEN ld > hd AND ld > 0 THEN ld ELSE 0 END AS mw FROM barx),
a1 AS (SELECT *, 100 * {mean("pw", 14)} / {mean("tr", 14)} AS pd, 100 * {mean("mw", 14)} / {mean("tr", 14)} AS md FROM a0),
a2 AS (SELECT *, 100 * abs(pd - md) / (pd + md + 1e-10) AS dx FROM a1),
t AS (SELECT *, round({mean("dx", 14)}, 9) AS adx, round({es.ema("close", 9)}, 9) AS e9, round({es.ema("close", 20)}, 9) AS e20, round({es.ema("close", 50)}, 9) AS e50 FROM a2),
g AS (SELECT *, coalesce(adx, 20) AS x, CASE WHEN coalesce(adx, 20) > 25 AND e9 > e20 AND e20 > e50 THEN 'trend_up' WHEN coalesce(adx, 20) > 25 AND e9 < e20 AND e20 < e50 THEN 'trend_down'
 WHEN coalesce(adx, 20) < 25 THEN 'range' ELSE 'undefined' END AS regime FROM t)
"""


@query("r01_r02_regimes", TREND + f"""
SELECT symbol, ts, regime, {r("CASE WHEN regime LIKE 'trend%' THEN least(0.8, 0.5 + (x - 25) / 75) WHEN regime = 'range' THEN 0.6 ELSE 0.3 END")} AS confidence,
 CASE WHEN regime LIKE 'trend%' THEN CASE WHEN x > 35 THEN 'strong' ELSE 'moderate' END WHEN regime = 'range' THEN 'weak' ELSE 'mixed' END AS strength,
 CASE WHEN x <= 25 THEN 'range' WHEN e9 > e20 AND e20 > e50 THEN 'trend_up' WHEN e9 < e20 AND e20 < e50 THEN 'trend_down' ELSE 'undefined' END AS label FROM g""")
def _(spark, sf):
    return rg.classify(rg.trend_inputs(v.bars(spark, sf))).select("symbol", "ts", "regime", rd("confidence").alias("confidence"), "strength", "label")


@query("r03_regime_limits", TREND + """
SELECT symbol, ts, g.regime, c.min_confidence, c.risk_reward FROM g JOIN (VALUES ('trend_up', 0.6::DOUBLE, 2.0::DOUBLE), ('trend_down', 0.6, 2.0), ('range', 0.6, 1.5), ('undefined', 0.8, 1.0)) c(regime, min_confidence, risk_reward) ON g.regime = c.regime""")
def _(spark, sf):
    return rg.with_limits(rg.classify(rg.trend_inputs(v.bars(spark, sf)))).select("symbol", "ts", "regime", "min_confidence", "risk_reward")


@query("r04_trend_flags", f"""
WITH a AS (SELECT *, round({es.ema("close", 20)}, 9) AS e20, round({es.ema("close", 50)}, 9) AS e50, {es.ema("tr", 14)} AS atr FROM barx), b AS (SELECT *, coalesce(atr / {mean("atr", 50)}, 1) AS ra FROM a)
SELECT symbol, ts, {flag("e20 > e50 AND close > e20")} AS uptrend, {flag("e20 < e50 AND close < e20")} AS downtrend, 1 - {flag("e20 > e50 AND close > e20")} - {flag("e20 < e50 AND close < e20")} AS ranging,
 {r("ra")} AS ratio, CASE WHEN ra <= 0.8 THEN 0 WHEN ra <= 1.2 THEN 1 ELSE 2 END AS volatility_class FROM b""")
def _(spark, sf):
    return rg.trend_flags(v.bars(spark, sf)).select("symbol", "ts", "uptrend", "downtrend", "ranging", rd("ratio").alias("ratio"), "volatility_class")


@query("r06_regime_distribution", TREND + f"""
, s AS (SELECT symbol, regime, count(*) AS n FROM g WHERE rn - 1 >= 50 GROUP BY 1, 2)
SELECT symbol, regime, n, {r("n / sum(n) OVER (PARTITION BY symbol)")} AS share, {flag("row_number() OVER (PARTITION BY symbol ORDER BY n DESC, regime DESC) = 1")} AS dominant FROM s""")
def _(spark, sf):
    return rg.distribution(rg.classify(rg.trend_inputs(v.bars(spark, sf))), 50).withColumn("share", rd("share"))


@query("r07_probability_regime", f"""
WITH a AS (SELECT symbol, ts, buy_volume / volume AS b, sell_volume / volume AS s, 1 - buy_volume / volume - sell_volume / volume AS h FROM bars),
m AS (SELECT *, round(b, 9) AS rb, round(s, 9) AS rs, round(h, 9) AS rh, greatest(round(b, 9), round(s, 9), round(h, 9)) AS t FROM a),
g AS (SELECT *, CASE WHEN rb = t AND rb > 0.6 THEN 'trend_up' WHEN rs = t AND rs > 0.6 THEN 'trend_down' WHEN rh > 0.5 THEN 'range' ELSE 'undefined' END AS regime FROM m)
SELECT symbol, ts, regime, {r("CASE WHEN regime = 'range' THEN rh ELSE t END")} AS confidence FROM g""")
def _(spark, sf):
    b = v.bars(spark, sf)
    p = [F.round(x, 9) for x in (F.col("sell_volume") / F.col("volume"), 1 - F.col("buy_volume") / F.col("volume") - F.col("sell_volume") / F.col("volume"),
                                 F.col("buy_volume") / F.col("volume"))]
    regime, conf = rg.from_probabilities(*p, 0.6)
    return b.select("symbol", "ts", regime.alias("regime"), rd(conf).alias("confidence"))


@query("r08_strength_flags", f"""
WITH a AS (SELECT *, {std("ret", 30)} AS vol FROM barx), b AS (SELECT *, CASE WHEN count(vol) OVER {fr(100)} >= 100 THEN quantile_cont(vol, 0.5) OVER {fr(100)} END AS med FROM a)
SELECT symbol, ts, {flag("vol > med * 1.1::DOUBLE")} AS high_vol, {flag("vol < med * 0.9::DOUBLE")} AS low_vol, {flag(f"close / {lag('close', 20)} - 1 > 0.01")} AS strong_up,
 {flag(f"close / {lag('close', 20)} - 1 < -0.01")} AS strong_down FROM b""")
def _(spark, sf):
    return rg.strength_flags(v.bars(spark, sf)).select("symbol", "ts", "high_vol", "low_vol", "strong_up", "strong_down")


@query("r10_trend_confirmation", TREND + f"""
, z AS (SELECT *, CASE WHEN e9 > e20 AND e20 > e50 THEN 1 WHEN e9 < e20 AND e20 < e50 THEN -1 END AS o, CASE WHEN rn >= 20 THEN CASE WHEN regr_slope(close, rn) OVER {fr(20)} > 0 THEN 1 ELSE -1 END END AS s FROM g),
m AS (SELECT *, coalesce((coalesce(o, 0) + coalesce(s, 0)) / nullif(CAST(o IS NOT NULL AS INT) + CAST(s IS NOT NULL AS INT), 0), 0) AS mv FROM z)
SELECT symbol, ts, {r("sign(mv)")} AS direction, {r("abs(mv)")} AS trend_strength FROM m""")
def _(spark, sf):
    return rg.confirm_trend(rg.trend_inputs(v.bars(spark, sf))).select("symbol", "ts", rd("direction").alias("direction"), rd("trend_strength").alias("trend_strength"))


DENSE = """
WITH sp AS (SELECT symbol AS s, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), gr AS (SELECT s, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS g FROM sp),
d0 AS (SELECT s AS symbol, g AS ts, close AS c, coalesce(volume, 0) AS volume, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS real FROM gr LEFT JOIN bars ON symbol = s AND ts = g),
d AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM d0)
"""


def _share(x, days):
    below = " + ".join(f"coalesce(CAST({lag(x, 24 * k)} < {x} AS INT), 0)" for k in range(1, days + 1))
    seen = " + ".join(f"CAST({lag(x, 24 * k)} IS NOT NULL AND {x} IS NOT NULL AS INT)" for k in range(1, days + 1))
    return f"(({below}) / nullif({seen}, 0))"


def _corrs(days):
    return ", ".join(f"CASE WHEN count(p{k}) OVER {fr(6)} >= 6 AND stddev_pop(volume) OVER {fr(6)} > 0 AND stddev_pop(p{k}) OVER {fr(6)} > 0 THEN corr(volume, p{k}) OVER {fr(6)} END AS c{k}" for k in range(1, days + 1))


HIST = DENSE + f"""
, l AS (SELECT *, {", ".join(f"{lag('volume', 24 * k)} AS p{k}" for k in range(1, 8))}, round((close / {lag("close", 6)} - 1) * 100, 9) AS m6, round((close / {lag("close", 1)} - 1) * 100, 9) AS m1,
  round((close / {lag("close", 3)} - 1) * 100, 9) AS m3, close / {lag("close", 1)} - 1 AS ret FROM d),
c AS (SELECT *, {_corrs(7)}, round({std("ret", 24)}, 12) AS vol FROM l),
h AS (SELECT *, coalesce(({" + ".join(f"coalesce(c{k}, 0)" for k in range(1, 8))}) / nullif({" + ".join(f"CAST(c{k} IS NOT NULL AS INT)" for k in range(1, 8))}, 0), 0.5) AS volume_pattern,
 coalesce({_share("m6", 30)}, 0.5) AS momentum_rank, {_share("m1", 14)} AS s1, {_share("m3", 14)} AS s3, {_share("m6", 14)} AS s6, {_share("vol", 30)} AS vp,
 avg(real) OVER {fr(24)} AS dq, least(row_number() OVER {W} / 24, 1) AS lc FROM c)
"""


@query("h01_volume_pattern", HIST + f"SELECT symbol, ts, {r('volume_pattern')} AS volume_pattern FROM h")
def _(spark, sf):
    return hi.volume_pattern(hi.dense(v.bars(spark, sf)), 6, 24).select("symbol", "ts", rd("volume_pattern").alias("volume_pattern"))


@query("h02_momentum_rank", HIST + f"SELECT symbol, ts, {r('momentum_rank')} AS momentum_rank FROM h")
def _(spark, sf):
    return hi.momentum_rank(hi.dense(v.bars(spark, sf)), 6).select("symbol", "ts", rd("momentum_rank").alias("momentum_rank"))


PCT = "coalesce((coalesce(s1, 0) + coalesce(s3, 0) + coalesce(s6, 0)) / nullif(CAST(s1 IS NOT NULL AS INT) + CAST(s3 IS NOT NULL AS INT) + CAST(s6 IS NOT NULL AS INT), 0), 0.5)"
VREG = "CASE WHEN vp IS NULL THEN 'UNKNOWN' WHEN vp > 0.8 THEN 'HIGH_VOL' WHEN vp < 0.2 THEN 'LOW_VOL' ELSE 'NORMAL_VOL' END"


@query("h03_momentum_percentile", HIST + f"SELECT symbol, ts, {r(PCT)} AS momentum_percentile FROM h")
def _(spark, sf):
    return hi.momentum_percentile(hi.dense(v.bars(spark, sf)), [1, 3, 6]).select("symbol", "ts", rd("momentum_percentile").alias("momentum_percentile"))


@query("r05_volatility_regime", HIST + f"SELECT symbol, ts, {r('vol', 8)} AS volatility, {r('coalesce(vp, 0.5)')} AS volatility_percentile, {VREG} AS volatility_regime FROM h")
def _(spark, sf):
    return hi.volatility_regime(hi.dense(v.bars(spark, sf)), 24).select("symbol", "ts", rd("volatility", 8).alias("volatility"),
                                                                        rd("volatility_percentile").alias("volatility_percentile"), "volatility_regime")


@query("h04_coverage", HIST + f"SELECT symbol, ts, {r('dq')} AS data_quality, {r('lc')} AS lookback_coverage FROM h")
def _(spark, sf):
    return hi.coverage(hi.dense(v.bars(spark, sf)), 24).select("symbol", "ts", rd("data_quality").alias("data_quality"), rd("lookback_coverage").alias("lookback_coverage"))


@query("h05_enhanced_row", HIST + f"""
SELECT symbol, ts, {r("volume_pattern")} AS volume_pattern, {r("momentum_rank")} AS momentum_rank, {r(PCT)} AS momentum_percentile, {VREG} AS volatility_regime, {r("dq")} AS data_quality FROM h WHERE real = 1""")
def _(spark, sf):
    return hi.enhanced(v.bars(spark, sf)).select("symbol", "ts", "volatility_regime", *[rd(c).alias(c) for c in (
        "volume_pattern", "momentum_rank", "momentum_percentile", "data_quality")])
