"""Order flow, tape and footprint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import flow as fl
from tickloom.plans import emasql as es
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import PART, W, flag, fr, lag, mean, rank, std, total

TP = "PARTITION BY symbol ORDER BY ts, seq"
BUY = "CASE WHEN side = 'buy' THEN quantity ELSE 0 END"
SELL = "CASE WHEN side = 'sell' THEN quantity ELSE 0 END"
B1 = "CASE WHEN side = 'buy' THEN 1 ELSE 0 END"
S1 = "CASE WHEN side = 'sell' THEN 1 ELSE 0 END"


def bal(b, s):
    return f"coalesce(({b} - {s}) / nullif({b} + {s}, 0), 0)"


def tw(s):
    return f"(PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL {s} SECONDS PRECEDING AND CURRENT ROW)"


@query("f01_ofi_time_windows", "SELECT symbol, seq, " + ", ".join(
    r(bal(f"sum({BUY}) OVER {tw(s)}", f"sum({SELL}) OVER {tw(s)}")) + f" AS ofi_{s}s" for s in (3600, 18000, 54000)) + " FROM ticks")
def _(spark, sf):
    return fl.ofi_time(v.ticks(spark, sf), [3600, 18000, 54000]).select(
        "symbol", "seq", *[rd(f"ofi_{s}s").alias(f"ofi_{s}s") for s in (3600, 18000, 54000)])


def rows(n):
    return fr(n, TP)


@query("f01_f04_flow_counts", f"""
WITH a AS (SELECT *, count(*) OVER {rows(100)} >= 10 AS ok, count(*) OVER {rows(20)} >= 20 AS full20,
 avg(quantity) OVER ({TP} ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS h1, avg(quantity) OVER {rows(10)} AS h2, sum({B1}) OVER {rows(20)} AS b20, sum({S1}) OVER {rows(20)} AS s20 FROM ticks),
b AS (SELECT *, CASE WHEN full20 THEN (b20 - s20) / greatest(b20 + s20, 1) END AS fi FROM a)
SELECT symbol, seq, {r(bal(f"sum({BUY}) OVER {rows(60)}", f"sum({SELL}) OVER {rows(60)}"))} AS ofi_60,
 {r(f"CASE WHEN ok THEN {bal(f'sum({BUY}) OVER {rows(100)}', f'sum({SELL}) OVER {rows(100)}')} ELSE 0 END")} AS volume_imbalance,
 {r(f"CASE WHEN ok THEN avg({B1}) OVER {rows(50)} ELSE 0.5 END")} AS aggression, {r(f"CASE WHEN ok THEN avg(CASE WHEN quantity > 20 THEN 1 ELSE 0 END) OVER {rows(100)} ELSE 0 END")} AS large_ratio,
 {r("CASE WHEN full20 THEN (h2 - h1) / h1 ELSE 0 END")} AS flow_momentum, {r("fi")} AS flow_imbalance, {r("CASE WHEN full20 THEN b20 / greatest(b20 + s20, 1) END")} AS buyer_ratio,
 {r(f"fi - {lag('fi', 10, TP)}")} AS imbalance_step FROM b""")
def _(spark, sf):
    return fl.flow_counts(v.ticks(spark, sf)).select("symbol", "seq", *[rd(c).alias(c) for c in (
        "ofi_60", "volume_imbalance", "aggression", "large_ratio", "flow_momentum", "flow_imbalance", "buyer_ratio", "imbalance_step")])


@query("f04_flow_ewm", f"""
WITH a AS (SELECT symbol, ts, seq, ({B1}) - ({S1}) AS d, ({B1}) + ({S1}) AS t, row_number() OVER ({TP}) AS rn FROM ticks)
SELECT symbol, seq, {r(es.ema("d", 20, over=f"({TP})"))} AS imbalance_ewm, {r(es.ema("t", 20, over=f"({TP})"))} AS intensity_ewm FROM a""")
def _(spark, sf):
    return fl.flow_ewm(v.ticks(spark, sf), 20).withColumns({"imbalance_ewm": rd("imbalance_ewm"), "intensity_ewm": rd("intensity_ewm")})


@query("f05_f14_pressure_and_delta", f"""
WITH a AS (SELECT *, buy_volume / nullif(buy_volume + sell_volume, 0) AS bp, {bal("buy_volume", "sell_volume")} AS im, buy_volume - sell_volume AS d FROM bars)
SELECT symbol, ts, {r("bp")} AS buy_pressure, {r("im")} AS imbalance, d AS delta, {r(total("d", 10))} AS net_flow, {r(f"{total('buy_volume', 10)} / nullif({total('sell_volume', 10)}, 0)")} AS flow_ratio,
 {r(mean("bp", 10, 1))} AS pressure_ma, {r(f"im - {lag('im')}")} AS acceleration, CAST(sum(d) OVER {W} AS BIGINT) AS cvd, {r(f"sum(d) OVER {W} / sum(volume) OVER {W}")} AS cvd_share,
 {r(f"(im - {mean('im', 20)}) / ({std('im', 20)} + 1e-10)")} AS imbalance_z,
 CASE WHEN close / {lag("close", 9)} > 1 AND {mean("d", 10)} < 0 THEN -1 WHEN close / {lag("close", 9)} < 1 AND {mean("d", 10)} > 0 THEN 1 ELSE 0 END AS divergence FROM a""")
def _(spark, sf):
    return fl.pressure(v.bars(spark, sf)).select("symbol", "ts", "delta", "cvd", "divergence", *[rd(c).alias(c) for c in (
        "buy_pressure", "imbalance", "net_flow", "flow_ratio", "pressure_ma", "acceleration", "cvd_share", "imbalance_z")])


@query("f05_run_lengths", f"""
WITH a AS (SELECT *, {flag("buy_trades > sell_trades")} AS l FROM bars), b AS (SELECT *, coalesce(CAST(l <> {lag("l")} AS INT), 1) AS nw FROM a),
c AS (SELECT *, sum(nw) OVER {W} AS run FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS n FROM c)
SELECT symbol, ts, n * l AS buy_run, n * (1 - l) AS sell_run FROM d""")
def _(spark, sf):
    return fl.run_lengths(v.bars(spark, sf)).select("symbol", "ts", "buy_run", "sell_run")


@query("f06_intensity", f"""
WITH a AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({TP})) / 1e6 AS g FROM ticks),
b AS (SELECT *, CASE WHEN count(g) OVER {rows(20)} >= 20 THEN 1 / greatest(quantile_cont(g, 0.5) OVER {rows(20)}, 0.001) END AS i FROM a)
SELECT symbol, seq, {r("i")} AS intensity, {r(std("i", 50, part=TP))} AS intensity_std, {r(f"coalesce(i / {mean('i', 50, part=TP)}, 1)")} AS surge, {r(f"i - {lag('i', 1, TP)}")} AS acceleration FROM b""")
def _(spark, sf):
    return fl.intensity(v.ticks(spark, sf), 20, 50).withColumns({c: rd(c) for c in ("intensity", "intensity_std", "surge", "acceleration")})


def _spd(s):
    return f"coalesce(n{s} / nullif(sp{s}, 0), 0)"


@query("f07_tape_speed", f"""
WITH a AS (SELECT *, CASE WHEN quantity > 2 * avg(quantity) OVER {tw(7200)} THEN 1 ELSE 0 END AS b7200, CASE WHEN quantity > 2 * avg(quantity) OVER {tw(28800)} THEN 1 ELSE 0 END AS b28800 FROM ticks),
b AS (SELECT symbol, seq, """ + ", ".join(
    f"count(*) OVER {tw(s)} AS n{s}, sum(quantity) OVER {tw(s)} AS q{s}, (epoch_us(ts) - min(epoch_us(ts)) OVER {tw(s)}) / 1e6 AS sp{s}, avg(b{s}) OVER {tw(s)} AS ls{s}"
    for s in (7200, 28800)) + f""" FROM a)
SELECT symbol, seq, """ + ", ".join(
    f"{r(_spd(s))} AS speed_{s}, {r(f'coalesce(q{s} / nullif(sp{s}, 0), 0)')} AS velocity_{s}, {r(f'ls{s}')} AS large_share_{s}" for s in (7200, 28800)) + f""",
 {r(f"coalesce(({_spd(7200)} - {_spd(28800)}) / nullif({_spd(28800)}, 0), 0)")} AS acceleration,
 CASE WHEN {_spd(28800)} > 0 AND {_spd(7200)} / nullif({_spd(28800)}, 0) > 2 THEN 'sudden_acceleration' WHEN ls28800 > 0.3 THEN 'high_intensity' END AS pattern FROM b""")
def _(spark, sf):
    return fl.tape_speed(v.ticks(spark, sf), 7200, 28800).select("symbol", "seq", "pattern", rd("acceleration").alias("acceleration"), *[
        rd(f"{c}_{s}").alias(f"{c}_{s}") for c in ("speed", "velocity", "large_share") for s in (7200, 28800)])


def _half(a, b):
    return f"({TP} ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


def _sp(f):
    return f"15.0::DOUBLE / nullif((max(epoch_us(ts)) OVER {f} - min(epoch_us(ts)) OVER {f}) / 1e6, 0)"


@query("f08_f10_f11_f12_tape_patterns", f"""
WITH z AS (SELECT *, lag(side) OVER ({TP}) AS ps, price - lag(price) OVER ({TP}) AS dp, lag(quantity) OVER ({TP}) AS pq FROM ticks),
a AS (SELECT *, {flag("side = 'buy' AND ps = 'buy' AND dp >= 0")} AS u, {flag("side = 'sell' AND ps = 'sell' AND dp <= 0")} AS d, {flag("dp > 0")} AS ri, {flag("dp < 0")} AS fa, {flag("quantity < pq")} AS sh FROM z),
b AS (SELECT *, count(*) OVER {rows(60)} AS n, sum(u) OVER {rows(9)} AS bs, sum(d) OVER {rows(9)} AS ss, sum(ri) OVER {rows(14)} AS r14, sum(fa) OVER {rows(14)} AS f14, sum({B1}) OVER {rows(15)} AS bc,
 min(side) OVER {rows(5)} = max(side) OVER {rows(5)} AS same, sum(sh) OVER {rows(4)} AS sh4, sum(quantity) OVER {_half(29, 15)} AS v1, sum(quantity) OVER {rows(15)} AS v2,
 {_sp(_half(29, 15))} AS s1, {_sp(rows(15))} AS s2, sum(quantity) OVER {rows(20)} AS v20, avg(quantity) OVER {rows(60)} * 20 AS base,
 (max(price) OVER {rows(20)} - min(price) OVER {rows(20)}) / avg(price) OVER {rows(20)} * 100 AS span, sum({BUY}) OVER {rows(20)} AS bv, sum({SELL}) OVER {rows(20)} AS sv FROM a)
SELECT symbol, seq, CASE WHEN n < 10 THEN 'none' WHEN bs >= 4 THEN 'buy' WHEN ss >= 4 THEN 'sell' ELSE 'none' END AS sweep,
 {r("CASE WHEN n >= 10 THEN least(greatest(bs, ss) * 0.2, 1) ELSE 0 END")} AS sweep_confidence, {flag("n >= 5 AND same AND sh4 = 0")} AS burst,
 CASE WHEN n < 15 THEN 0 WHEN r14 > 9.8 AND bc > 7 THEN 1 WHEN f14 > 9.8 AND bc <= 7 THEN -1 ELSE 0 END AS momentum,
 {flag("n >= 30 AND v2 < v1 * 0.5 AND s2 < s1 * 0.5")} AS exhausted,
 CASE WHEN n >= 60 AND v20 >= base * 1.1::DOUBLE AND span < 150 THEN CASE WHEN bv > sv * 1.5 THEN 'bullish' WHEN sv > bv * 1.5 THEN 'bearish' ELSE 'neutral' END ELSE 'none' END AS absorption FROM b""")
def _(spark, sf):
    return fl.tape_patterns(v.ticks(spark, sf)).withColumn("sweep_confidence", rd("sweep_confidence"))


@query("f08_flow_sweeps", f"""
WITH a AS (SELECT *, {bal("buy_volume", "sell_volume")} AS o FROM bars)
SELECT symbol, ts, CASE WHEN count(*) OVER {fr(3)} >= 3 AND min(o) OVER {fr(3)} > 0.3 THEN 'bullish' WHEN count(*) OVER {fr(3)} >= 3 AND max(o) OVER {fr(3)} < -0.3 THEN 'bearish' ELSE 'none' END AS direction,
 {r(f"abs(avg(o) OVER {fr(3)})")} AS strength FROM a""")
def _(spark, sf):
    return fl.flow_sweeps(v.bars(spark, sf), 0.3, 3).select("symbol", "ts", "direction", rd("strength").alias("strength"))


@query("f09_iceberg_prints", f"""
SELECT symbol, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts, CAST(floor(price) AS BIGINT) AS level, count(*) AS executions, {r("avg(quantity)")} AS avg_volume,
 {r("least(count(*) * 0.15, 1)")} AS confidence FROM ticks t GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND stddev_pop(quantity) / avg(quantity) < 0.5""")
def _(spark, sf):
    return fl.iceberg_prints(v.ticks(spark, sf), "6 hours", 3, 0.5).withColumns({"avg_volume": rd("avg_volume"), "confidence": rd("confidence")})


@query("f10_absorption_bars", f"""
WITH a AS (SELECT *, {bal("buy_volume", "sell_volume")} AS o, volume / {mean("volume", 20)} AS st, ret * 100 AS mv FROM barx)
SELECT symbol, ts, {r("st")} AS strength, {r("mv")} AS move, CASE WHEN o > 0.2 THEN 'buying' WHEN o < -0.2 THEN 'selling' ELSE 'neutral' END AS type FROM a WHERE st >= 1.5 AND abs(mv) < 20""")
def _(spark, sf):
    return fl.absorption_bars(v.bars(spark, sf), 1.5, 20).select("symbol", "ts", rd("strength").alias("strength"), rd("move").alias("move"), "type")


@query("f03_f13_tape_momentum", f"WITH a AS (SELECT *, row_number() OVER ({TP}) AS rn FROM ticks), b AS (SELECT symbol, seq, " + ", ".join(
    f"CASE WHEN rn >= {n} THEN regr_slope(price, rn) OVER {rows(n)} / avg(price) OVER {rows(n)} * 100 END AS p{n}, "
    f"CASE WHEN rn >= {n} THEN (sum(quantity) OVER {rows(n // 2)} - sum(quantity) OVER {_half(n - 1, n // 2)}) / sum(quantity) OVER {_half(n - 1, n // 2)} END AS v{n}, "
    f"CASE WHEN rn >= {n} THEN {bal(f'sum({BUY}) OVER {rows(n)}', f'sum({SELL}) OVER {rows(n)}')} END AS d{n}" for n in (10, 30, 60)) + f""" FROM a)
SELECT symbol, seq, """ + ", ".join(f"{r(f'p{n}')} AS price_{n}, {r(f'v{n}', 7)} AS volume_{n}, {r(f'd{n}')} AS direction_{n}" for n in (10, 30, 60)) + f""",
 {r("CASE WHEN p10 * p30 < 0 AND abs(p10) > 0.5 AND abs(p30) > 0.5 THEN abs(p10 - p30) ELSE 0 END")} AS divergence FROM b""")
def _(spark, sf):
    return fl.tape_momentum(v.ticks(spark, sf)).select("symbol", "seq", rd("divergence").alias("divergence"), *[
        rd(f"{c}_{n}", d).alias(f"{c}_{n}") for c, d in (("price", 6), ("volume", 7), ("direction", 6)) for n in (10, 30, 60)])


FOOT = f"""
WITH a AS (SELECT *, buy_volume - sell_volume AS d, ret * 100 AS mv, {bal("buy_volume", "sell_volume")} AS im, volume / {mean("volume", 20, 1)} AS ra FROM barx),
p AS (SELECT symbol, ts, round(least(0.7 * (least(ra / 2, 1) + 0.3), 1), 9) AS confidence, 'p_reversal' AS name, 'reversal' AS kind, 'bullish' AS direction FROM a WHERE least(ra / 2, 1) > 0.7 AND d > 100 AND abs(mv) < 10
 UNION ALL SELECT symbol, ts, round(least(0.65 * abs(im * 2), 1), 9), 'b_reversal', 'reversal', 'bearish' FROM a WHERE d < -100 AND mv < -0.05 AND im < -0.3
 UNION ALL SELECT symbol, ts, round(least(0.75 * (ra / 2), 1), 9), 'exhaustion', 'exhaustion', 'neutral' FROM a WHERE ra > 2 AND abs(mv) < 5
 UNION ALL SELECT symbol, ts, round(least(0.65 * (d / 100), 1), 9), 'initiative_buying', 'continuation', 'bullish' FROM a WHERE d > 50 AND mv > 0.1
 UNION ALL SELECT symbol, ts, round(least(0.65 * (abs(d) / 100), 1), 9), 'initiative_selling', 'continuation', 'bearish' FROM a WHERE d < -50 AND mv < -0.1)
"""


@query("f15_footprints", FOOT + f"SELECT symbol, ts, name, kind, direction, {r('confidence')} AS confidence FROM p")
def _(spark, sf):
    return fl.footprints(v.bars(spark, sf)).select("symbol", "ts", F.explode("patterns").alias("p")).select(
        "symbol", "ts", "p.name", "p.kind", "p.direction", rd("p.confidence").alias("confidence"))


@query("f16_next_action", FOOT + f"""
, t AS (SELECT symbol, ts, arg_max(kind, (confidence, name)) AS kind, arg_max(direction, (confidence, name)) AS direction, max(confidence) AS c FROM p GROUP BY 1, 2)
SELECT b.symbol, b.ts, CASE WHEN kind IS NULL THEN 'hold' WHEN kind = 'exhaustion' THEN 'wait' WHEN direction = 'bullish' THEN 'buy' ELSE 'sell' END AS action,
 {r("CASE WHEN kind = 'reversal' THEN 0.5 WHEN kind = 'continuation' THEN 0.3 ELSE 0 END * CASE WHEN direction = 'bullish' THEN 1 ELSE -1 END")} AS expected, {r("coalesce(c * 0.8, 0)")} AS confidence
FROM bars b LEFT JOIN t ON b.symbol = t.symbol AND b.ts = t.ts""")
def _(spark, sf):
    return fl.next_action(fl.footprints(v.bars(spark, sf))).select("symbol", "ts", "action", rd("expected").alias("expected"), rd("confidence").alias("confidence"))


@query("f21_pattern_shares", FOOT + f"SELECT name, count(*) AS n, {r('count(*) / (SELECT count(*) FROM p)')} AS share FROM p GROUP BY 1")
def _(spark, sf):
    return fl.pattern_shares(fl.footprints(v.bars(spark, sf))).withColumn("share", rd("share"))


def _top(col, k):
    return f"(SELECT {col} FROM ticks GROUP BY 1 ORDER BY count(*) DESC, {col} LIMIT {k})"


@query("f17_agents", f"""
WITH a AS (SELECT *, {flag(f"buy_agent IN {_top('buy_agent', 10)}")} AS tb, {flag(f"sell_agent IN {_top('sell_agent', 10)}")} AS tsl, {flag(f"buy_agent IN {_top('buy_agent', 5)}")} AS ib,
 {flag(f"sell_agent IN {_top('sell_agent', 5)}")} AS isl, {flag(f"buy_agent IS DISTINCT FROM lag(buy_agent) OVER ({TP})")} AS bc, {flag(f"sell_agent IS DISTINCT FROM lag(sell_agent) OVER ({TP})")} AS sc,
 row_number() OVER ({TP}) AS rn, list(buy_agent) OVER {rows(50)} AS bl FROM ticks),
b AS (SELECT *, (bc + sc) / 2 AS tu, max(CASE WHEN bc = 1 THEN rn END) OVER ({TP}) AS st FROM a)
SELECT symbol, seq, tb AS top_buyer, tsl AS top_seller, bc AS buyer_changed, sc AS seller_changed, {r(mean("tu", 50, part=TP))} AS turnover, {r(mean("bc", 50, part=TP))} AS switch_rate,
 {r(f"{total('ib', 50, part=TP)} - {total('isl', 50, part=TP)}")} AS institutional_flow, {r("CASE WHEN rn >= 50 THEN len(list_distinct(bl)) END")} AS buyer_diversity, rn - st AS buyer_repeats FROM b""")
def _(spark, sf):
    return fl.agents(v.ticks(spark, sf), 10, 5, 50).select("symbol", "seq", "top_buyer", "top_seller", "buyer_changed", "seller_changed", "buyer_repeats",
        *[rd(c).alias(c) for c in ("turnover", "switch_rate", "institutional_flow", "buyer_diversity")])


@query("f18_f19_large_flow", f"""
WITH a AS (SELECT *, list(quantity) OVER {rows(50)} AS l, abs(price / {lag("price", 1, TP)} - 1) / ln(1 + quantity) AS im FROM ticks),
b AS (SELECT *, {rank("quantity", "l", 50)} AS rk FROM a), c AS (SELECT *, CASE WHEN rk > 0.95 THEN ({B1}) - ({S1}) ELSE 0 END AS sb FROM b)
SELECT symbol, seq, {r("rk")} AS size_rank, {r(total("sb", 20, part=TP))} AS large_imbalance, {r("im")} AS impact, {r(mean("im", 20, part=TP))} AS impact_ma FROM c""")
def _(spark, sf):
    return fl.large_flow(v.ticks(spark, sf), 50, 20).withColumns({c: rd(c) for c in ("size_rank", "large_imbalance", "impact", "impact_ma")})


@query("f02_large_flags", f"""
WITH q AS (SELECT symbol AS s, quantile_cont(quantity, 0.75) AS p75, quantile_cont(quantity, 0.95) AS p95 FROM ticks GROUP BY 1),
a AS (SELECT symbol, ts, seq, {flag("quantity > p75")} AS l75, {flag("quantity > p95")} AS l95 FROM ticks JOIN q ON symbol = s)
SELECT symbol, seq, l75 AS large_p75, l95 AS large_p95, {r(mean("l75", 50, part=TP))} AS large_p75_share, {r(mean("l95", 50, part=TP))} AS large_p95_share FROM a""")
def _(spark, sf):
    t = v.ticks(spark, sf)
    return fl.large_flags(t, fl.size_thresholds(t, [0.75, 0.95]), 50).select(
        "symbol", "seq", "large_p75", "large_p95", rd("large_p75_share").alias("large_p75_share"), rd("large_p95_share").alias("large_p95_share"))


@query("f20_flow_alerts", f"""
WITH a AS (SELECT *, {bal("buy_volume", "sell_volume")} AS o, greatest(buy_volume, sell_volume) / volume AS ls FROM bars)
SELECT symbol, ts, {r("o")} AS ofi, concat_ws(',', CASE WHEN abs(o) > 0.7 THEN 'ofi' END, CASE WHEN ls > 0.8 THEN 'large' END, CASE WHEN trades > 5 THEN 'speed' END) AS alerts
FROM a WHERE abs(o) > 0.7 OR ls > 0.8 OR trades > 5""")
def _(spark, sf):
    return fl.flow_alerts(v.bars(spark, sf), 0.7, 0.8, 5).select("symbol", "ts", rd("ofi").alias("ofi"), F.concat_ws(",", "alerts").alias("alerts"))
