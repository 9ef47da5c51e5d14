"""Signals, consensus and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book as bk, indicators as ti, regime as rg, signals as sg
from tickloom.operators.windows import by_time, div, pct_change, rmean, rstd
from tickloom.plans import views as v
from tickloom.plans.q_book import SCORE
from tickloom.plans.q_indicators import LEVELS
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import W, flag, fr, lag, mean, std, total

IN = f"""
WITH i0 AS (SELECT *, coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 0)::DOUBLE AS d, {mean("tr", 14)} AS atr, {mean("close", 20)} AS sma FROM barx),
i AS (SELECT *, abs(ret) AS m, 0.5 + 0.5 * abs(d) AS c, CASE WHEN sma IS NULL THEN 'undefined' WHEN close > sma * 1.05::DOUBLE THEN 'trend_up' WHEN close < sma * 0.95::DOUBLE THEN 'trend_down' ELSE 'range' END AS regime FROM i0)
"""


def _in(spark, sf):
    return sg.inputs(v.bars(spark, sf))


@query("d01_gated_signal", IN + f"""
, a AS (SELECT *, CASE WHEN m IS NULL OR atr IS NULL THEN 'no_market_data' WHEN abs(d) < 0.3 THEN 'direction' WHEN m < 0.0001 THEN 'magnitude' WHEN c < 0.6 THEN 'confidence' END AS blocked,
 greatest(atr * 1.5, 5.0) * CASE WHEN regime LIKE 'trend%' THEN 0.8 WHEN regime = 'range' THEN 1.2 ELSE 1 END AS st FROM i),
b AS (SELECT *, CASE WHEN blocked IS NOT NULL THEN 'none' WHEN d > 0 THEN 'buy' ELSE 'sell' END AS action, greatest(m * close, st, st * 2.0) AS tk FROM a),
e AS (SELECT *, CASE action WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 END AS sd FROM b), f AS (SELECT *, round_even((close - sd * st) / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS stop, round_even((close + sd * tk) / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS target FROM e)
SELECT symbol, ts, action, blocked, stop + 0::DOUBLE AS stop, target + 0::DOUBLE AS target, {r("abs(target - close) / nullif(abs(close - stop), 0)")} AS risk_reward FROM f""")
def _(spark, sf):
    return sg.gated_signal(_in(spark, sf), 5.0, 2.0, 0.5).select("symbol", "ts", "action", "blocked", "stop", "target", rd("risk_reward").alias("risk_reward"))


def _hyb(spark, sf):
    t = _in(spark, sf).where("ret IS NOT NULL")
    sign = lambda x, lim: F.when(x > lim, 1).when(x < -lim, -1).otherwise(0)
    return sg.hybrid(t.withColumns({"tick_signal": sign(F.col("direction"), 0.2), "tick_confidence": F.col("confidence"),
                                    "book_signal": sign(F.col("ret"), 0.01), "book_confidence": 0.5 + F.least(F.abs("ret"), F.lit(0.5))}))


HYB = IN + f"""
, a AS (SELECT *, CASE WHEN d > 0.2 THEN 1 WHEN d < -0.2 THEN -1 ELSE 0 END AS ts1, c AS tc, CASE WHEN ret > 0.01 THEN 1 WHEN ret < -0.01 THEN -1 ELSE 0 END AS bs, 0.5 + least(abs(ret), 0.5) AS bc FROM i WHERE ret IS NOT NULL),
b AS (SELECT *, CASE WHEN regime LIKE 'trend%' THEN 0.6 WHEN regime = 'range' THEN 0.3 ELSE 0.5 END AS wt, CASE WHEN regime LIKE 'trend%' THEN 0.4 WHEN regime = 'range' THEN 0.7 ELSE 0.5 END AS wb,
 CASE WHEN regime LIKE 'trend%' THEN CASE WHEN ts1 = bs AND ts1 <> 0 THEN 1.2 ELSE 1 END WHEN regime = 'range' THEN CASE WHEN bc > 0.7 THEN 1.1 ELSE 1 END ELSE 0.8 END AS bo FROM a),
e AS (SELECT *, round(ts1 * tc * wt + bs * bc * wb, 9) AS vl, round((tc * wt + bc * wb) * bo, 9) AS cf, ts1 * bs < 0 AND tc > 0.7 AND bc > 0.7 AS clash FROM b),
h AS (SELECT *, CASE WHEN clash OR cf < 0.5 OR abs(vl) < 0.3 THEN 0 WHEN vl > 0 THEN 1 ELSE -1 END AS signal, least(CASE WHEN clash THEN cf * 0.5 ELSE cf END, 1) AS blend FROM e)
"""


@query("d02_hybrid_signal", HYB + f"SELECT symbol, ts, signal, {r('blend')} AS blend FROM h")
def _(spark, sf):
    return _hyb(spark, sf).select("symbol", "ts", "signal", rd("blend").alias("blend"))


@query("d03_position_size", HYB + f"""
SELECT symbol, ts, {r("CASE WHEN signal = 0 THEN 0 ELSE least(100000 * least(blend * 0.25, 0.1) * CASE WHEN regime LIKE 'trend%' THEN CASE WHEN c > 0.7 THEN 1.2 ELSE 1 END WHEN regime = 'range' THEN 0.8 ELSE 0.5 END / close, 90) END")} AS contracts FROM h""")
def _(spark, sf):
    return sg.position_size(_hyb(spark, sf), 100000.0, 90.0).select("symbol", "ts", rd("contracts").alias("contracts"))


@query("d04_flow_vote", IN + f"""
, a AS (SELECT *, round({mean("d", 5, 1)}, 9) AS sl, d - {lag("d")} AS ve, sum(buy_volume - sell_volume) OVER {W} AS cvd, buy_volume - sell_volume AS dl, close / {lag("close", 9)} - 1 AS ch, volume / {mean("volume", 20)} AS bu,
 min(d) OVER {fr(3)} AS lo, max(d) OVER {fr(3)} AS hi FROM i), b AS (SELECT *, {mean("dl", 10)} AS tr10 FROM a),
e AS (SELECT *, CASE WHEN d > 0.3 AND sl > 0.3 AND ve > 0 THEN 'buy' WHEN d < -0.3 AND sl < -0.3 AND ve < 0 THEN 'sell' END AS o,
 coalesce(CASE WHEN ch < 0 AND tr10 > 0 THEN 'buy' WHEN ch > 0 AND tr10 < 0 THEN 'sell' END, CASE WHEN abs(cvd) > 1000 THEN CASE WHEN cvd > 0 THEN 'buy' ELSE 'sell' END END) AS de,
 CASE WHEN bu >= 1.5 AND abs(ret) < 0.2 AND d > 0.2 THEN 'sell' WHEN bu >= 1.5 AND abs(ret) < 0.2 AND d < -0.2 THEN 'buy' END AS ab, CASE WHEN rn >= 3 AND lo > 0.3 THEN 'buy' WHEN rn >= 3 AND hi < -0.3 THEN 'sell' END AS sw FROM b),
u AS (SELECT symbol, ts, o AS a, least(abs(d) * 2, 1)::DOUBLE AS c FROM e UNION ALL SELECT symbol, ts, de, CASE WHEN abs(cvd) > 1000 THEN 0.7::DOUBLE ELSE 0.6 END FROM e UNION ALL SELECT symbol, ts, ab, 0.7 FROM e UNION ALL SELECT symbol, ts, sw, 0.8 FROM e),
g AS (SELECT symbol, ts, count(*) FILTER (a = 'buy') AS nb, count(*) FILTER (a = 'sell') AS ns, avg(c) FILTER (a = 'buy') AS cb, avg(c) FILTER (a = 'sell') AS cs, arg_max(a, (c, a)) FILTER (a IS NOT NULL) AS ta, max(c) FILTER (a IS NOT NULL) AS tc FROM u GROUP BY 1, 2)
SELECT symbol, ts, CASE WHEN nb + ns = 0 THEN 'hold' WHEN nb > ns THEN 'buy' WHEN ns > nb THEN 'sell' ELSE ta END AS action, {r("CASE WHEN nb + ns = 0 THEN 0 WHEN nb > ns THEN cb WHEN ns > nb THEN cs ELSE tc END")} AS vote_confidence FROM g""")
def _(spark, sf):
    return sg.flow_vote(_in(spark, sf), 0.3, 1000).select("symbol", "ts", "action", rd("vote_confidence").alias("vote_confidence"))


@query("d05_liquidity_signal", f"""
WITH a AS (SELECT symbol, seq, {SCORE} AS sc, coalesce((list_sum(bid_volumes) - list_sum(ask_volumes)) / nullif(list_sum(bid_volumes) + list_sum(ask_volumes), 0), 0) AS im, greatest(bid_volumes[1] - 150, 0) AS hb, greatest(ask_volumes[1] - 150, 0) AS ha,
 bid_volumes[1] / (list_sum(bid_volumes) + 1) AS us, ask_volumes[1] / (list_sum(ask_volumes) + 1) AS ic FROM book_l2),
b AS (SELECT *, CASE WHEN sc < 0.3 THEN 'hold' WHEN im > 0.3 THEN 'buy' WHEN im < -0.3 THEN 'sell' ELSE 'hold' END AS action, least((0.5 + abs(im) * 0.3) * CASE WHEN CASE WHEN im > 0 THEN hb > 0 ELSE ha > 0 END THEN 1.2 ELSE 1 END, 0.9) AS ba FROM a),
e AS (SELECT *, CASE WHEN action = 'hold' THEN 0 ELSE ba END * CASE WHEN us > 0.7 THEN 1.1 ELSE 1 END * CASE WHEN ic > 0.5 THEN 0.8 ELSE 1 END AS cf FROM b)
SELECT symbol, seq, action, {r("CASE WHEN sc < 0.3 THEN 0 ELSE least(cf * 0.4 + sc * 0.3 + (1 - us) * 0.3, 1) END")} AS signal_confidence FROM e""")
def _(spark, sf):
    b = bk.depth(bk.depth_analysis(v.book_l2(spark, sf)))
    l1 = lambda s: F.greatest(F.element_at(f"{s}_volumes", 1) - 150, F.lit(0.0))
    b = b.withColumns({"hidden_bid": l1("bid"), "hidden_ask": l1("ask"), "consumption": F.col("bid_share_l1"), "iceberg": F.col("ask_share_l1")})
    return sg.liquidity_signal(b).select("symbol", "seq", "action", rd("signal_confidence").alias("signal_confidence"))


@query("d06_tape_signal", IN + f"""
, a AS (SELECT *, trades / {mean("trades", 20)} AS sr, (close / {lag("close", 5)} - 1) * 10 AS pm, CASE WHEN rn >= 3 AND min(d) OVER {fr(3)} > 0.3 THEN 'buy' WHEN rn >= 3 AND max(d) OVER {fr(3)} < -0.3 THEN 'sell' ELSE 'none' END AS sw FROM i),
b AS (SELECT *, CASE WHEN sr > 2 THEN greatest(least((sr - 1) * 0.5, 1) * 0.8, 0.5) WHEN sr > 1.5 THEN 0.5 ELSE 0 END AS sc, CASE WHEN sr > 2 THEN 'buy' ELSE 'hold' END AS sa, CASE WHEN sw <> 'none' THEN 0.8 ELSE 0 END AS pc2, CASE WHEN sw <> 'none' THEN sw ELSE 'hold' END AS pa,
 CASE WHEN (pm > 0.5 AND d > 0.3) OR (pm < -0.5 AND d < -0.3) THEN least((abs(pm) + abs(d)) / 2, 1) ELSE 0 END AS mc, CASE WHEN pm > 0.5 AND d > 0.3 THEN 'buy' WHEN pm < -0.5 AND d < -0.3 THEN 'sell' ELSE 'hold' END AS ma FROM a),
e AS (SELECT *, {", ".join(f"round(CASE WHEN sa = '{x}' THEN sc * 0.3 ELSE 0 END + CASE WHEN pa = '{x}' THEN pc2 * 0.4 ELSE 0 END + CASE WHEN ma = '{x}' THEN mc * 0.3 ELSE 0 END, 9)::DOUBLE AS t_{x}" for x in ("buy", "sell", "hold"))},
 CASE WHEN sc > 0 THEN 0.3 ELSE 0 END + CASE WHEN pc2 > 0 THEN 0.4 ELSE 0 END + CASE WHEN mc > 0 THEN 0.3 ELSE 0 END AS tt FROM b),
f AS (SELECT *, greatest(t_buy, t_sell, t_hold) AS tp FROM e)
SELECT symbol, ts, CASE WHEN tp = 0 THEN 'hold' WHEN t_buy = tp THEN 'buy' WHEN t_sell = tp THEN 'sell' ELSE 'hold' END AS action, {r("coalesce(tp / nullif(tt, 0), 0)")} AS tape_confidence FROM f""")
def _(spark, sf):
    from tickloom.operators.flow import flow_sweeps
    w = by_time("symbol")
    t = flow_sweeps(_in(spark, sf), 0.3, 3).drop("strength").withColumn("sweep", F.when(F.col("direction") == "bullish", "buy").when(F.col("direction") == "bearish", "sell").otherwise("none"))
    t = t.withColumns({"direction": F.col("ofi"), "speed_ratio": div(F.col("trades"), rmean(F.col("trades"), w, 20)), "price_momentum": pct_change(F.col("close"), w, 5) * 10})
    return sg.tape_signal(t).select("symbol", "ts", "action", rd("tape_confidence").alias("tape_confidence"))


AG = IN + f"""
, a AS (SELECT *, {mean("d", 5, 1)} AS o5, {mean("d", 10, 1)} AS o10, (buy_volume - sell_volume) / volume AS sv, high - low AS rg, turnover / volume AS vw, volume / {mean("volume", 20, 1)} AS vr, greatest(buy_volume, sell_volume) / volume AS lr, trades / {mean("trades", 20, 1)} AS ve FROM i),
b AS (SELECT *, {mean("sv", 5, 1)} AS v5, {mean("sv", 10, 1)} AS v10, coalesce((rg - {mean("rg", 20, 1)}) / nullif({std("rg", 20, 2)}, 0), 0) AS z, (close - vw) / vw AS vd, (2 * close - high - low) / nullif(high - low, 0) AS sk, {std("ret", 5, 2)} / ({std("ret", 20, 2)} + 1e-10) AS vra, close / {lag("close", 5)} - 1 AS r5 FROM a),
e AS (SELECT *, round((o5 * 0.6 + o10 * 0.4) * 0.4 + (v5 * 0.6 + v10 * 0.4) * 0.3 + d * 0.3, 9) AS s1,
 round(CASE WHEN vr > 1.2 THEN 0.3 WHEN vr < 0.8 THEN -0.3 ELSE 0 END + CASE WHEN z < -1 THEN 0.2 * abs(z) WHEN z > 1 THEN -0.1 * z ELSE 0 END + d * 0.3, 9) AS s2,
 round((o5 * 0.6 + o10 * 0.4) * 0.3 + v5 * 0.25 + CASE WHEN lr > 0.3 THEN 0.2 * sign(o5 * 0.6 + o10 * 0.4) ELSE 0 END + CASE WHEN ve > 1.5 THEN 0.15 * sign(o5 * 0.6 + o10 * 0.4) ELSE 0 END + CASE WHEN vd > 0.002 THEN 0.1 WHEN vd < -0.002 THEN -0.1 ELSE 0 END + d * 0.2, 9) AS s3,
 round(CASE WHEN sk > 0.2 AND v5 > 0.3 THEN 0.4 WHEN sk < -0.2 AND v5 < -0.3 THEN -0.4 ELSE 0 END + CASE WHEN lr > 0.6 THEN sign(round(vd, 9)) * 0.3 ELSE 0 END + CASE WHEN vra > 1.5 THEN sign(r5) * 0.2 ELSE 0 END, 9) AS s4 FROM b)
"""


def _agents(spark, sf):
    w = by_time("symbol")
    t = _in(spark, sf)
    t = t.withColumns({"sv": (F.col("buy_volume") - F.col("sell_volume")) / F.col("volume"), "rg": F.col("high") - F.col("low"), "vw": F.col("turnover") / F.col("volume"),
                       "large_ratio": F.greatest("buy_volume", "sell_volume") / F.col("volume"), "book_imbalance": F.col("direction")})
    d = F.col("direction")
    return sg.agent_scores(t.withColumns({
        "ofi_5": rmean(d, w, 5, 1), "ofi_10": rmean(d, w, 10, 1), "vol_5": rmean(F.col("sv"), w, 5, 1), "vol_10": rmean(F.col("sv"), w, 10, 1),
        "volume_ratio": div(F.col("volume"), rmean(F.col("volume"), w, 20, 1)), "velocity": div(F.col("trades"), rmean(F.col("trades"), w, 20, 1)),
        "spread_z": F.coalesce(div(F.col("rg") - rmean(F.col("rg"), w, 20, 1), rstd(F.col("rg"), w, 20, 2)), F.lit(0.0)),
        "vwap_distance": F.round((F.col("close") - F.col("vw")) / F.col("vw"), 9), "skew": div(2 * F.col("close") - F.col("high") - F.col("low"), F.col("rg")),
        "concentration": F.col("large_ratio"), "vol_ratio": rstd(F.col("ret"), w, 5, 2) / (rstd(F.col("ret"), w, 20, 2) + 1e-10), "ret_5": pct_change(F.col("close"), w, 5)}))


NAMES = {"flow": ("s1", 0.5, 0.3, 1.5, 1.0), "liquidity": ("s2", 9.0, 0.3, 1.0, 0.9), "tape": ("s3", 0.6, 0.35, 1.2, 0.95), "footprint": ("s4", 0.5, 0.3, 1.3, 0.9)}


@query("d07_agent_scores", AG + "SELECT symbol, ts, " + ", ".join(
    f"{r(f'coalesce({s}, 0)')} AS {n}_score, CASE WHEN {s} > {st} THEN 2 WHEN {s} > {wk} THEN 1 WHEN {s} < -{st} THEN -2 WHEN {s} < -{wk} THEN -1 ELSE 0 END AS {n}_level, {r(f'CASE WHEN {s} IS NULL THEN 0 ELSE least(abs({s}) * {k}, {tp}) END')} AS {n}_confidence"
    for n, (s, st, wk, k, tp) in NAMES.items()) + " FROM e")
def _(spark, sf):
    t = _agents(spark, sf)
    return t.select("symbol", "ts", *[f"{n}_level" for n in NAMES], *[rd(F.coalesce(f"{n}_score", F.lit(0.0))).alias(f"{n}_score") for n in NAMES],
                    *[rd(F.when(F.col(f"{n}_score").isNull(), 0.0).otherwise(F.col(f"{n}_confidence"))).alias(f"{n}_confidence") for n in NAMES])


CONS = """cs0 AS (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS agents, coalesce(sum(confidence) FILTER (action = 'buy'), 0) AS b0, coalesce(sum(confidence) FILTER (action = 'sell'), 0) AS s0 FROM agent_signals g GROUP BY 1),
cs AS (SELECT *, round(b0, 9) AS b, round(s0, 9) AS s FROM cs0)"""


@query("d08_flow_consensus", f"""WITH {CONS} SELECT ts, agents, {r("b0")} AS buy_strength, {r("s0")} AS sell_strength, CASE WHEN b + s = 0 THEN 'neutral' WHEN b > s THEN 'bullish' ELSE 'bearish' END AS direction,
 {r("coalesce(greatest(b, s) / nullif(b + s, 0), 0)")} AS strength, {r("coalesce(greatest(b, s) / nullif(b + s, 0) * abs(b - s) / nullif(b + s, 0), 0)")} AS confidence FROM cs""")
def _(spark, sf):
    return sg.consensus(v.agent_signals(spark, sf), "1 hour").withColumns({c: rd(c) for c in ("buy_strength", "sell_strength", "strength", "confidence")})


@query("d09_signal_quality", f"""WITH {CONS}, su AS (SELECT agent AS ag, count(*) AS t, sum(CASE WHEN seq % 5 < 3 THEN 1 ELSE 0 END) AS w FROM agent_signals GROUP BY 1),
j AS (SELECT g.*, w / t * least(t / 100, 1) AS hist, coalesce(greatest(b, s) / nullif(b + s, 0), 0) AS st, CASE WHEN b + s = 0 THEN 'neutral' WHEN b > s THEN 'bullish' ELSE 'bearish' END AS fl FROM agent_signals g JOIN su ON agent = ag JOIN cs ON cs.ts = time_bucket(INTERVAL '1 hour', g.ts, TIMESTAMP '1970-01-01'))
SELECT seq, agent, {r("least(confidence * 0.25 + CASE WHEN st = 0 THEN 0.5 WHEN (action = 'buy' AND fl = 'bullish') OR (action = 'sell' AND fl = 'bearish') THEN least(st * 1.2, 1) WHEN (action = 'buy' AND fl = 'bearish') OR (action = 'sell' AND fl = 'bullish') THEN greatest(0.2 - st * 0.5, 0) ELSE 0.5 END * 0.30 + hist * 0.20 + (0.5 + CASE WHEN extract(hour FROM ts) BETWEEN 10 AND 16 THEN 0.2 ELSE 0 END) * 0.15 + 0.05, 1)")} AS quality FROM j""")
def _(spark, sf):
    s = v.agent_signals(spark, sf).withColumn("success", F.col("seq") % 5 < 3)
    return sg.quality_score(s, sg.consensus(s, "1 hour"), "1 hour").select("seq", "agent", rd("quality").alias("quality"))


DEC = AG + """
, q0 AS (SELECT *, (0.5 + d / 2 - 0.5) * 2 AS ml, coalesce(s1, 0) AS a1, coalesce(s3, 0) AS a3, CASE WHEN s1 IS NULL THEN 0 ELSE least(abs(s1) * 1.5, 1) END AS c1, CASE WHEN s3 IS NULL THEN 0 ELSE least(abs(s3) * 1.2, 0.95) END AS c3 FROM e),
q1 AS (SELECT *, coalesce((a1 * c1 + a3 * c3) / nullif(c1 + c3, 0), 0) AS ac, abs(a1 - a3) / 2 AS sd, (CAST(buy_volume <> 0 AS INT) + CAST(sell_volume <> 0 AS INT)) / 2 AS fq FROM q0),
q AS (SELECT *, round(greatest(least(ml * 0.4 + ac * 0.6, 1), -1), 9) AS x FROM q1)
"""


def _decisions(spark, sf):
    t = _agents(spark, sf).withColumn("probability", 0.5 + F.col("direction") / 2)
    t = t.withColumns({f"{n}_{c}": F.when(F.col(f"{n}_score").isNull(), 0.0).otherwise(F.col(f"{n}_{c}")) for n in ("flow", "tape") for c in ("score", "confidence")})
    return sg.decide(t, [("flow_score", "flow_confidence"), ("tape_score", "tape_confidence")], ["buy_volume", "sell_volume"])


@query("d10_consensus_decision", DEC + f"""
SELECT symbol, ts, {r("ml")} AS ml_signal, {r("ac")} AS agent_consensus, {r("x")} AS combined, CASE WHEN x > 0.6 THEN 'strong_buy' WHEN x > 0.3 THEN 'buy' WHEN x > 0.1 THEN 'weak_buy' WHEN x < -0.6 THEN 'strong_sell' WHEN x < -0.3 THEN 'sell' WHEN x < -0.1 THEN 'weak_sell' ELSE 'hold' END AS decision,
 {r("greatest(least((1 - abs(ml - ac) / 2) * 0.3 + abs(ml + ac) / 2 * 0.3 + (1 - least(sd, 1)) * 0.2 + fq * 0.2, 1), 0)")} AS decision_confidence FROM q""")
def _(spark, sf):
    return _decisions(spark, sf).select("symbol", "ts", "decision", *[rd(c).alias(c) for c in ("ml_signal", "agent_consensus", "combined", "decision_confidence")])


@query("d11_adapted_weights", DEC + f"""
, z AS (SELECT *, lead(x) OVER {W} AS nx FROM q), y AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50),
g AS (SELECT symbol, sum(CASE WHEN sign(ml) * sign(nx) > 0 THEN 1 ELSE 0 END) AS mr, sum(CASE WHEN sign(ac) * sign(nx) > 0 THEN 1 ELSE 0 END) AS ar FROM y GROUP BY 1), h AS (SELECT *, 0.28::DOUBLE + 0.3 * mr / (mr + ar) AS mw, 0.42::DOUBLE + 0.3 * ar / (mr + ar) AS aw FROM g)
SELECT symbol, CAST(mr AS BIGINT) AS ml_right, CAST(ar AS BIGINT) AS agent_right, {r("mw / (mw + aw)")} AS model_weight, {r("aw / (mw + aw)")} AS agent_weight FROM h""")
def _(spark, sf):
    return sg.adapted_weights(_decisions(spark, sf), 50).withColumns({"model_weight": rd("model_weight"), "agent_weight": rd("agent_weight")})


@query("d12_rewards", IN + f"""
, a AS (SELECT *, CASE WHEN d > 0.2 THEN 'buy' WHEN d < -0.2 THEN 'sell' ELSE 'hold' END AS act, lead(ret) OVER {W} AS mv, CASE WHEN trades % 3 = 0 THEN 'reversal' WHEN trades % 3 = 1 THEN 'continuation' END AS pt,
 CASE WHEN {lag("d")} > 0 THEN 'bullish' ELSE 'bearish' END AS fl, coalesce(abs({lag("d")}), 0) AS fs, (high - low) / close / 100 AS sl FROM i), b AS (SELECT *, CASE act WHEN 'buy' THEN mv WHEN 'sell' THEN -mv ELSE 0 END AS pnl FROM a WHERE mv IS NOT NULL),
e AS (SELECT *, CASE WHEN (act = 'buy' AND mv > 0) OR (act = 'sell' AND mv < 0) THEN least(abs(mv) * 10, 1) WHEN act = 'hold' AND abs(mv) < 0.001 THEN 0.5 ELSE 0 END * c AS acc,
 CASE WHEN pt IS NULL THEN 0 ELSE least(CASE WHEN pt = 'reversal' THEN CASE WHEN pnl > 0 THEN 1.0 ELSE 0.2 END ELSE CASE WHEN pnl > 0 THEN 0.8 ELSE 0.5 END END * CASE WHEN sl < 0.0001 THEN 1.2 WHEN sl > 0.001 THEN 0.8 ELSE 1 END, 1) END AS tm FROM b),
f AS (SELECT *, acc * 5 + tm * 3 - CASE WHEN fs > 0.7 AND ((fl = 'bullish' AND act = 'sell') OR (fl = 'bearish' AND act = 'buy')) THEN 5 ELSE 0 END + CASE WHEN trades % 4 >= 2 THEN 2 ELSE 0 END AS fr FROM e)
SELECT symbol, ts, act AS action, {r("acc")} AS flow_accuracy, {r("tm")} AS timing, {r("fr")} AS flow_reward, {r("pnl * 10 + fr")} AS reward FROM f""")
def _(spark, sf):
    w = by_time("symbol")
    t = _in(spark, sf)
    d, before = F.col("direction"), F.lag("direction").over(w)
    t = t.withColumns({
        "action": F.when(d > 0.2, "buy").when(d < -0.2, "sell").otherwise("hold"), "movement": F.lead("ret").over(w), "pattern": F.when(F.col("trades") % 3 == 0, "reversal").when(F.col("trades") % 3 == 1, "continuation"),
        "flow": F.when(before > 0, "bullish").otherwise("bearish"), "flow_strength": F.coalesce(F.abs(before), F.lit(0.0)), "slippage": (F.col("high") - F.col("low")) / F.col("close") / 100, "confirmations": F.col("trades") % 4})
    t = t.where("movement IS NOT NULL").withColumn("pnl", F.when(F.col("action") == "buy", F.col("movement")).when(F.col("action") == "sell", -F.col("movement")).otherwise(0.0))
    return sg.reward(t).select("symbol", "ts", "action", *[rd(c).alias(c) for c in ("flow_accuracy", "timing", "flow_reward", "reward")])


@query("d13_adapted_thresholds", f"""
WITH a AS (SELECT regime, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wr, avg(pnl) AS ap FROM closed_trades GROUP BY 1)
SELECT regime, trades, {r("wr")} AS win_rate, {r("ap", 4)} AS avg_pnl, {r("CASE WHEN trades < 10 THEN 0.6 WHEN wr < 0.45 THEN least(0.63, 0.8) WHEN wr > 0.6 THEN greatest(0.582, 0.4) ELSE 0.6 END")} AS threshold FROM a""")
def _(spark, sf):
    return sg.adapt_thresholds(v.closed_trades(spark, sf), 0.6, 10).withColumns({"win_rate": rd("win_rate"), "avg_pnl": rd("avg_pnl", 4), "threshold": rd("threshold")})


@query("d14_u04_alerts", """
WITH RECURSIVE v AS (SELECT symbol, ts, 'jump' AS rule, 'high' AS severity, abs(ret) AS value FROM barx WHERE abs(ret) > 0.5 UNION ALL SELECT symbol, ts, 'busy', 'low', volume::DOUBLE FROM barx WHERE volume > 200),
f AS (SELECT symbol, rule, min(ts) AS ts FROM v GROUP BY 1, 2 UNION ALL SELECT f.symbol, f.rule, (SELECT min(v.ts) FROM v WHERE v.symbol = f.symbol AND v.rule = f.rule AND v.ts > f.ts + INTERVAL 14400 SECOND) AS ts FROM f WHERE f.ts IS NOT NULL)
SELECT v.symbol, v.ts, v.rule, v.severity, """ + r("v.value") + """ AS value FROM v JOIN f ON v.symbol = f.symbol AND v.rule = f.rule AND v.ts = f.ts""")
def _(spark, sf):
    t = _in(spark, sf)
    rules = [sg.AlertRule("jump", "magnitude", F.col("magnitude") > 0.5, "high"), sg.AlertRule("busy", "volume", F.col("volume") > 200, "low")]
    return sg.alerts(t, rules, 14400).withColumn("value", rd("value"))


@query("d15_kelly_size", IN + f"""
, a AS (SELECT *, {std("ret", 20)} AS vol, {std("close", 20)} / 100 AS co, 1 - close / max(close) OVER {fr(20)} AS dd, 0.4 + (trades % 5) / 20 AS wr FROM i),
b AS (SELECT *, greatest(0, least((wr * 1.5 - (1 - wr) * 1.0) / 1.5, 0.25)) AS k, CASE WHEN vol > 0.04 THEN 0.7 WHEN vol > 0.025 THEN 0.85 WHEN vol < 0.01 THEN 1.2 WHEN vol < 0.015 THEN 1.1 ELSE 1 END * CASE WHEN co > 0.8 THEN 0.6 WHEN co > 0.6 THEN 0.75 WHEN co > 0.4 THEN 0.9 ELSE 1 END
 * CASE regime WHEN 'range' THEN 0.95 WHEN 'undefined' THEN 0.8 ELSE 1.15 END * CASE WHEN c < 0.6 THEN 0.85 WHEN c > 0.8 THEN 1.05 ELSE 1 END * least(CASE WHEN c > 0.8 THEN 1.2 WHEN c > 0.7 THEN 1.1 WHEN c < 0.5 THEN 0.7 WHEN c < 0.6 THEN 0.85 ELSE 1 END, 1.5)
 * CASE WHEN dd > 0.1 THEN 0.5 WHEN dd > 0.05 THEN 0.7 WHEN dd > 0.02 THEN 0.85 ELSE 1 END AS mu FROM a)
SELECT symbol, ts, {r("k", 9)} AS kelly, {r("greatest(0.1, least(mu, 2))", 12)} AS multiplier, {r("99991 * 0.02 * k / close * greatest(0.1, least(mu, 2))")} AS size FROM b""")
def _(spark, sf):
    w = by_time("symbol")
    from tickloom.operators.windows import last_rows
    t = _in(spark, sf).withColumns({
        "volatility": rstd(F.col("ret"), w, 20), "correlation": rstd(F.col("close"), w, 20) / 100, "drawdown": 1 - F.col("close") / F.max("close").over(last_rows(w, 20)),
        "win_rate": 0.4 + (F.col("trades") % 5) / 20.0, "avg_win": F.lit(1.5), "avg_loss": F.lit(1.0)})
    return sg.kelly_size(t, 99991.0, 0.02).select("symbol", "ts", *[rd(c, n).alias(c) for c, n in (("kelly", 9), ("multiplier", 12), ("size", 6))])


@query("d17_blended_stops", LEVELS + f"""
, s AS (SELECT symbol, ts, close - 2 * {mean("tr", 14)} AS a, close - close * {std("ret", 20)} * sqrt(30.0::DOUBLE) * 2 AS vv, coalesce(lb * 0.995, close * 0.98) AS sr, CASE WHEN abs(ret) > 0.5 THEN 'high_volatility' WHEN abs(ret) > 0.1 THEN 'trending' ELSE 'ranging' END AS mk FROM c),
x AS (SELECT *, CASE mk WHEN 'trending' THEN 0.4 WHEN 'ranging' THEN 0.3 ELSE 0.4 END AS wa, CASE mk WHEN 'trending' THEN 0.35 WHEN 'ranging' THEN 0.2 ELSE 0.5 END AS wv, CASE mk WHEN 'trending' THEN 0.25 WHEN 'ranging' THEN 0.5 ELSE 0.1 END AS ws FROM s)
SELECT symbol, ts, {r("(coalesce(a * wa, 0) + coalesce(vv * wv, 0) + coalesce(sr * ws, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE wa END + CASE WHEN vv IS NULL THEN 0 ELSE wv END + CASE WHEN sr IS NULL THEN 0 ELSE ws END)")} AS stop_long FROM x""")
def _(spark, sf):
    m = F.abs("ret")
    kind = F.when(m > 0.5, "high_volatility").when(m > 0.1, "trending").otherwise("ranging")
    return sg.blended_stop(ti.stops(v.bars(spark, sf)), kind, "long").select("symbol", "ts", rd("stop_long").alias("stop_long"))


@query("d18_threshold_violations", IN + """
SELECT i.regime, CAST(sum(CASE WHEN c < mc THEN 1 ELSE 0 END) AS BIGINT) AS confidence, CAST(sum(CASE WHEN abs(d) < md THEN 1 ELSE 0 END) AS BIGINT) AS direction, CAST(sum(CASE WHEN coalesce(m, 0) < mm THEN 1 ELSE 0 END) AS BIGINT) AS magnitude
FROM i JOIN (VALUES ('trend_up', 0.6, 0.7, 0.003), ('trend_down', 0.6, 0.7, 0.003), ('range', 0.6, 0.5, 0.0015), ('undefined', 0.8, 0.8, 0.005)) l(regime, mc, md, mm) ON i.regime = l.regime GROUP BY 1""")
def _(spark, sf):
    return sg.violations(_in(spark, sf), rg.limits(spark))


@query("d19_model_vote", f"""
WITH a AS (SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS models, sum((predicted - 1) * confidence) / sum(confidence) AS d, avg(confidence) AS mc, stddev_pop(predicted - 1) AS s FROM predictions p GROUP BY 1, 2)
SELECT symbol, ts, models, {r("d")} AS direction, {r("mc")} AS mean_confidence, {r("greatest(0.001, abs(d) * (1 - s))")} AS magnitude FROM a""")
def _(spark, sf):
    p = v.predictions(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return sg.model_vote(p, ["symbol", "ts"]).withColumns({c: rd(c) for c in ("direction", "mean_confidence", "magnitude")})
