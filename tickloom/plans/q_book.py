"""Order-book microstructure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregates as ag, book as bk, joins as jo
from tickloom.plans import views as v
from tickloom.plans.q_aggregates import TOPS
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import flag, fr, lag, mean, std, total

K = "PARTITION BY k ORDER BY ts"
KS = "PARTITION BY k ORDER BY ts, seq"
TP = "PARTITION BY symbol ORDER BY ts, seq"
SP = "PARTITION BY symbol ORDER BY seq"
RAW_TOPS = """tops AS (SELECT k, date_trunc('hour', ts) AS ts, arg_max(price, (ts, seq)) FILTER (side = 'bid') AS bid,
  arg_max(price, (ts, seq)) FILTER (side = 'ask') AS ask, avg(quantity) FILTER (side = 'bid') AS bid_qty, avg(quantity) FILTER (side = 'ask') AS ask_qty
  FROM quotes GROUP BY 1, 2 HAVING bid IS NOT NULL AND ask IS NOT NULL)"""


def tops(spark, sf):
    return ag.book_tops(v.quotes(spark, sf), "1 hour", both=True)


@query("b01_b04_spread_series", f"""
WITH {RAW_TOPS}, a AS (SELECT *, ask - bid AS spread, (ask + bid) / 2 AS mid, {flag(f"bid IS DISTINCT FROM {lag('bid', 1, K)}")} AS cb, {flag(f"ask IS DISTINCT FROM {lag('ask', 1, K)}")} AS ca FROM tops)
SELECT k, ts, {r("spread")} AS spread, {r("spread / mid * 100")} AS spread_pct, {r(mean("spread", 10, part=K))} AS spread_ma, {r(mean("spread", 50, part=K))} AS spread_ma_long,
 {r(std("spread", 50, part=K))} AS spread_std, {r("spread / nullif(stddev_samp(mid) OVER (PARTITION BY k, CAST(ts AS DATE)), 0)", 5)} AS spread_norm,
 {r(total("cb", 10, part=K))} AS bid_changes, {r(total("ca", 10, part=K))} AS ask_changes, {r(std("bid", 10, part=K))} AS bid_stability, {r(std("ask", 10, part=K))} AS ask_stability FROM a""")
def _(spark, sf):
    return bk.spread_series(tops(spark, sf)).select("k", "ts", rd("spread_norm", 5).alias("spread_norm"), *[rd(c).alias(c) for c in (
        "spread", "spread_pct", "spread_ma", "spread_ma_long", "spread_std", "bid_changes", "ask_changes", "bid_stability", "ask_stability")])


@query("b04_velocity", f"""
WITH {RAW_TOPS}, a AS (SELECT *, ask - bid AS spread, ln(bid_qty + 1) - ln(ask_qty + 1) AS p FROM tops),
b AS (SELECT *, (spread - {lag("spread", 1, K)}) / 18000 AS ds, (p - {lag("p", 1, K)}) / 18000 AS dp FROM a)
SELECT k, ts, {r("avg(ds) OVER w", 8)} AS spread_velocity, {r("avg(dp) OVER w", 9)} AS pressure_velocity FROM b
WINDOW w AS ({K} RANGE BETWEEN INTERVAL 17999 SECONDS PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return bk.velocity(tops(spark, sf), 18000).select("k", "ts", rd("spread_velocity", 8).alias("spread_velocity"),
                                                      rd("pressure_velocity", 9).alias("pressure_velocity"))


B = "bid_volumes[{i}]"
A = "ask_volumes[{i}]"
IMBALANCE = lambda i: f"(bid_volumes[{i}] - ask_volumes[{i}]) / (bid_volumes[{i}] + ask_volumes[{i}] + 1)"


@query("b02_level_imbalance", "SELECT symbol, seq, " + ", ".join(
    f"{r(IMBALANCE(i))} AS imbalance_l{i}, bid_volumes[{i}] - ask_volumes[{i}] + 0.0 AS difference_l{i}" for i in range(1, 6)) + f""",
 {r(f"{IMBALANCE(1)} * 0.5 + {IMBALANCE(2)} * 0.3 + {IMBALANCE(3)} * 0.2")} AS imbalance_weighted,
 {r("ln(list_sum(bid_volumes[1:3]) + 1) - ln(list_sum(ask_volumes[1:3]) + 1)")} AS pressure,
 {r("(list_sum(bid_volumes[1:3]) - list_sum(ask_volumes[1:3])) / (list_sum(bid_volumes[1:3]) + list_sum(ask_volumes[1:3]) + 1)")} AS skew FROM book_l2""")
def _(spark, sf):
    return bk.level_imbalance(v.book_l2(spark, sf)).select(
        "symbol", "seq", *[rd(f"imbalance_l{i}").alias(f"imbalance_l{i}") for i in range(1, 6)],
        *[rd(f"difference_l{i}").alias(f"difference_l{i}") for i in range(1, 6)],
        *[rd(c).alias(c) for c in ("imbalance_weighted", "pressure", "skew")])


@query("b03_b05_depth_and_micro_price", "SELECT symbol, seq, " + ", ".join(
    f"list_sum({s}_volumes[1:{i}]) AS {s}_depth_{i}" for s in ("bid", "ask") for i in (1, 3, 5)) + f""",
 list_sum(bid_volumes) + list_sum(ask_volumes) AS total_depth, {r("list_sum(bid_volumes) / (list_sum(ask_volumes) + 1)")} AS depth_ratio,
 {r("bid_volumes[1] / (list_sum(bid_volumes) + 1)")} AS bid_share_l1, {r("ask_volumes[1] / (list_sum(ask_volumes) + 1)")} AS ask_share_l1,
 (bid_prices[1] - bid_prices[3]) / 2 AS bid_slope, (ask_prices[3] - ask_prices[1]) / 2 AS ask_slope,
 {r("(bid_prices[1] * ask_volumes[1] + ask_prices[1] * bid_volumes[1]) / (bid_volumes[1] + ask_volumes[1] + 1)")} AS micro_price,
 {r("(bid_prices[1] * ask_volumes[1] + ask_prices[1] * bid_volumes[1]) / (bid_volumes[1] + ask_volumes[1] + 1) - (bid_prices[1] + ask_prices[1]) / 2")} AS micro_deviation FROM book_l2""")
def _(spark, sf):
    return bk.depth(v.book_l2(spark, sf)).select(
        "symbol", "seq", *[f"{s}_depth_{i}" for s in ("bid", "ask") for i in (1, 3, 5)], "total_depth", "bid_slope", "ask_slope",
        *[rd(c).alias(c) for c in ("depth_ratio", "bid_share_l1", "ask_share_l1", "micro_price", "micro_deviation")])


@query("b06_b07_price_impact", f"""
WITH a AS (SELECT *, price - {lag("price", 1, TP)} AS dp, price / {lag("price", 1, TP)} - 1 AS ret, price / {lag("price", 5, TP)} - 1 AS ret5,
 CASE side WHEN 'buy' THEN quantity WHEN 'sell' THEN -quantity ELSE 0 END AS fl FROM ticks),
b AS (SELECT *, quantity * sign(dp) AS sv, abs(ret) / (quantity + 1) AS il FROM a)
SELECT symbol, seq, {r(f"{std('dp', 100, part=TP)} / nullif({std('sv', 100, part=TP)}, 0)")} AS kyle, {r(mean("il", 100, part=TP))} AS amihud,
 {r(f"CASE WHEN {total('fl', 100, part=TP)} IS NOT NULL THEN abs(ret5) / greatest(abs({total('fl', 100, part=TP)}), 1) END")} AS kyle_flow FROM b""")
def _(spark, sf):
    x = bk.price_impact_measures(v.ticks(spark, sf), 100)
    return x.select("symbol", "seq", rd("kyle").alias("kyle"), rd("amihud").alias("amihud"),
                    rd("kyle_flow").alias("kyle_flow"))


@query("b08_effective_spread", f"""
WITH {RAW_TOPS} SELECT t.k, t.seq, {r("2 * abs(t.price - (o.bid + o.ask) / 2)")} AS effective_spread
FROM trades_k t ASOF LEFT JOIN tops o ON t.k = o.k AND t.ts >= o.ts""")
def _(spark, sf):
    return bk.effective_spread(v.trades_k(spark, sf), tops(spark, sf)).select("k", "seq", rd("effective_spread").alias("effective_spread"))


@query("b08_spread_proxy", f"SELECT symbol, ts, {r('2 * sqrt(abs(ret)) * close')} AS proxy FROM barx")
def _(spark, sf):
    from tickloom.operators.windows import by_time, pct_change
    return v.bars(spark, sf).select("symbol", "ts", rd(2 * F.sqrt(F.abs(pct_change(F.col("close"), by_time("symbol")))) * F.col("close")).alias("proxy"))


def _ice(s):
    return flag(f"abs({s}1 - {lag(s + '1', 1, SP)}) < {s}1 * 0.1::DOUBLE AND {s}1 > {mean(s + '1', 10, part=SP)}")


@query("b09_book_patterns", f"""
WITH a AS (SELECT symbol, seq, bid_volumes[1] AS b1, ask_volumes[1] AS a1, bid_volumes[2] AS b2, ask_volumes[2] AS a2,
 ln(list_sum(bid_volumes[1:3]) + 1) - ln(list_sum(ask_volumes[1:3]) + 1) AS p FROM book_l2)
SELECT symbol, seq, {flag(f"b1 > 3 * {mean('b1', 20, part=SP)}")} AS large_bid, {flag(f"a1 > 3 * {mean('a1', 20, part=SP)}")} AS large_ask, {_ice("b")} AS iceberg_bid, {_ice("a")} AS iceberg_ask,
 {flag("b1 = 0 AND b2 = 0")} AS sweep_bid, {flag("a1 = 0 AND a2 = 0")} AS sweep_ask, {flag(f"p > {mean('p', 10, part=SP)} + {std('p', 10, part=SP)}")} AS accumulation,
 {flag(f"p < {mean('p', 10, part=SP)} - {std('p', 10, part=SP)}")} AS distribution FROM a""")
def _(spark, sf):
    return bk.book_patterns(v.book_l2(spark, sf), 10, 20)


@query("b10_book_trade_flow", f"""
WITH j AS (SELECT q.k, q.ts, q.seq, q.side, q.price, t.price AS rp, t.quantity AS rq FROM quotes q ASOF LEFT JOIN trades_k t ON q.k = t.k AND q.ts >= t.ts),
a AS (SELECT *, sum(CASE WHEN side = 'bid' THEN coalesce(rq, 0) ELSE 0 END) OVER w AS buy, sum(CASE WHEN side = 'ask' THEN coalesce(rq, 0) ELSE 0 END) OVER w AS sell,
 sum(CASE WHEN rp <= price THEN rq ELSE 0 END) OVER w AS lo, sum(CASE WHEN rp > price THEN rq ELSE 0 END) OVER w AS hi FROM j
 WINDOW w AS ({K} RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW))
SELECT k, seq, {r("(buy - sell) / (buy + sell + 1)")} AS ofi, {r("lo / (lo + hi + 1)")} AS at_bid_share, {r("hi / (lo + 1)")} AS aggressiveness FROM a""")
def _(spark, sf):
    x = bk.book_trade_flow(v.quotes(spark, sf), v.trades_k(spark, sf), 7200)
    return x.select("k", "seq", *[rd(c).alias(c) for c in ("ofi", "at_bid_share", "aggressiveness")])


@query("b11_combined_books", f"""
WITH o AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(quantity) AS BIGINT) AS q FROM quotes WHERE side = 'bid' GROUP BY 1, 2),
p AS (SELECT k, date_trunc('hour', ts) AS ts, CAST(sum(quantity) AS BIGINT) AS q, count(*) AS n FROM quotes WHERE side = 'ask' GROUP BY 1, 2)
SELECT k, ts, o.q AS offer_volume, p.q AS price_volume, p.n AS price_updates FROM o FULL JOIN p USING (k, ts)""")
def _(spark, sf):
    q = v.quotes(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    offer = q.where("side = 'bid'").groupBy("k", "ts").agg(F.sum("quantity").alias("volume"))
    price = q.where("side = 'ask'").groupBy("k", "ts").agg(F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("updates"))
    return bk.combine(offer, price, ["k", "ts"])


SCORE = """least((list_sum(bid_volumes) + list_sum(ask_volumes)) / 1000, 1) * 0.7::DOUBLE
 + greatest(0, 1 - (ask_prices[1] - bid_prices[1]) / ((ask_prices[1] + bid_prices[1]) / 2) * 10000 / 50) * 0.3::DOUBLE"""


@query("b12_depth_analysis", f"""
WITH a AS (SELECT *, list_sum(bid_volumes) AS b, list_sum(ask_volumes) AS s FROM book_l2)
SELECT symbol, seq, b AS bid_depth, s AS ask_depth, {r("coalesce((b - s) / nullif(b + s, 0), 0)")} AS depth_imbalance,
 {r("coalesce((bid_prices[1] * s + ask_prices[1] * b) / nullif(b + s, 0), (bid_prices[1] + ask_prices[1]) / 2)")} AS weighted_mid, {r(SCORE)} AS liquidity_score FROM a""")
def _(spark, sf):
    return bk.depth_analysis(v.book_l2(spark, sf), 10).select(
        "symbol", "seq", "bid_depth", "ask_depth", *[rd(c).alias(c) for c in ("depth_imbalance", "weighted_mid", "liquidity_score")])


@query("b13_major_levels", f"""
WITH a AS (SELECT symbol, seq, 'bid' AS side, list_avg(bid_volumes) AS m, unnest(range(1, 6)) AS level, unnest(bid_prices) AS price, unnest(bid_volumes) AS volume FROM book_l2
 UNION ALL SELECT symbol, seq, 'ask', list_avg(ask_volumes), unnest(range(1, 6)), unnest(ask_prices), unnest(ask_volumes) FROM book_l2)
SELECT symbol, seq, side, level, price, volume, {r("volume / m")} AS significance FROM a WHERE volume / m > 1.7""")
def _(spark, sf):
    return bk.major_levels(v.book_l2(spark, sf), 1.7, 20).withColumn("significance", rd("significance"))


@query("b13_liquidity_gaps", f"""
SELECT symbol, seq, len(list_filter([abs(bid_prices[i] - bid_prices[i + 1]) FOR i IN range(1, 5)], lambda g: g > bid_prices[1] * 0.0001 * 3)) AS bid_gaps,
 len(list_filter([abs(ask_prices[i] - ask_prices[i + 1]) FOR i IN range(1, 5)], lambda g: g > ask_prices[1] * 0.0001 * 3)) AS ask_gaps, 0.5::DOUBLE AS bid_widest, 0.5::DOUBLE AS ask_widest FROM book_l2""")
def _(spark, sf):
    return bk.liquidity_gaps(v.book_l2(spark, sf), depth=10).select("symbol", "seq", "bid_gaps", "ask_gaps", "bid_widest", "ask_widest")


@query("b14_regular_prints", f"""
WITH a AS (SELECT symbol, CAST(ts AS DATE) AS day, CAST(floor(price) AS BIGINT) AS level, quantity,
 (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol, CAST(ts AS DATE), floor(price) ORDER BY ts, seq)) / 1e6 AS gap FROM ticks),
b AS (SELECT symbol, day, level, count(*) AS n, avg(quantity) AS m, stddev_pop(quantity) / avg(quantity) AS sc, stddev_pop(gap) / nullif(avg(gap), 0) AS gc FROM a GROUP BY 1, 2, 3)
SELECT symbol, day, level, n AS executions, {r("m")} AS avg_volume, {r("sc")} AS size_cv, {r("gc")} AS gap_cv FROM b WHERE n >= 3 AND sc < 0.6 AND gc < 0.9""")
def _(spark, sf):
    return bk.regular_prints(v.ticks(spark, sf), 3, 0.6, 0.9).withColumns({c: rd(c) for c in ("avg_volume", "size_cv", "gap_cv")})


@query("b15_hidden_liquidity", f"""
WITH {RAW_TOPS}, j AS (SELECT t.*, CASE WHEN t.seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o.bid_qty * 3 AS vb, o.ask_qty * 3 AS va
  FROM trades_k t ASOF LEFT JOIN tops o ON t.k = o.k AND t.ts >= o.ts),
a AS (SELECT *, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER w AS b, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS s, avg(quantity) OVER w AS m,
 list(price) OVER w AS pl, list(quantity) OVER w AS ql FROM j WINDOW w AS {fr(20, KS)}),
b AS (SELECT *, CASE WHEN b > vb * 1.5 THEN b - vb ELSE 0 END AS hb, CASE WHEN s > va * 1.5 THEN s - va ELSE 0 END AS ha,
 [pl[i] FOR i IN range(1, len(pl) + 1) IF ql[i] > m * 1.5] AS big FROM a)
SELECT k, seq, {r("hb")} AS hidden_bid, {r("ha")} AS hidden_ask, {r("(hb + ha) / (vb + va)")} AS hidden_ratio, {r("len(big) / len(pl)")} AS large_share,
 {r("CASE WHEN len(big) > 0 THEN list_stddev_pop(big) / list_avg(big) END")} AS quiet FROM b""")
def _(spark, sf):
    t = jo.asof(v.trades_k(spark, sf), tops(spark, sf).withColumn("seq", F.lit(0).cast("long")), ["k"], ["bid_qty", "ask_qty"])
    t = t.select("k", "ts", "seq", "price", "quantity", F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"),
                 (F.col("r_bid_qty") * 3).alias("visible_bid"), (F.col("r_ask_qty") * 3).alias("visible_ask"))
    return bk.hidden_liquidity(t, 20, 1.5).withColumns({c: rd(c) for c in ("hidden_bid", "hidden_ask", "hidden_ratio", "large_share", "quiet")})


@query("b16_consumption", f"""
WITH {RAW_TOPS}, m AS (SELECT k, date_trunc('hour', ts) AS b, quantity, abs(price - {lag("price", 1, KS)}) AS mv FROM trades_k),
g AS (SELECT k, b, CAST(sum(quantity) AS BIGINT) AS ex, avg(mv) AS am, count(*) AS n FROM m GROUP BY 1, 2),
h AS (SELECT g.k, g.b, ex, sum(CASE WHEN coalesce(mv, 0) > am * 2 THEN 1 ELSE 0 END) / n AS ag FROM m JOIN g ON m.k = g.k AND m.b = g.b GROUP BY 1, 2, 3, n),
t AS (SELECT tops.k, tops.ts, bid_qty + ask_qty AS lq, coalesce(ex, 0) AS ex, ag FROM tops LEFT JOIN h ON tops.k = h.k AND tops.ts = h.b),
u AS (SELECT *, ex / nullif({lag("lq", 1, K)}, 0) AS rate, lq - {lag("lq", 1, K)} + ex AS net, row_number() OVER ({K}) AS i FROM t)
SELECT k, ts, ex AS executed, {r("rate")} AS rate, {r("net")} AS net_change, {r("CASE WHEN net IS NULL THEN 0 ELSE greatest(0, net) END / nullif(ex, 0)")} AS replenishment, {r("ag")} AS aggressive,
 {r(f"CASE WHEN count(rate) OVER {fr(20, K)} >= 10 THEN regr_slope(rate, i) OVER {fr(20, K)} END")} AS trend FROM u""")
def _(spark, sf):
    return bk.consumption(tops(spark, sf), v.trades_k(spark, sf), "1 hour").select(
        "k", "ts", "executed", *[rd(c).alias(c) for c in ("rate", "net_change", "replenishment", "aggressive", "trend")])


@query("b17_map_book", f"""
WITH a AS (SELECT symbol, seq, list_sum(bid_volumes) AS b, list_sum(ask_volumes) AS s, list_min(ask_prices) - list_max(bid_prices) AS sp FROM book_l2)
SELECT symbol, seq, b AS bid_depth, s AS ask_depth, sp AS spread, {r("coalesce((b - s) / nullif(b + s, 0), 0)")} AS imbalance, {r("(b + s) / sp")} AS score FROM a""")
def _(spark, sf):
    return bk.map_book(v.book_l2(spark, sf)).select("symbol", "seq", "bid_depth", "ask_depth", "spread", rd("imbalance").alias("imbalance"), rd("score").alias("score"))


@query("b18_event_features", f"""
WITH g AS (SELECT *, date_trunc('hour', ts) AS b, seq % 30 AS pos FROM quotes),
a AS (SELECT k AS gk, b AS gb, sum(CASE WHEN side = 'bid' THEN quantity ELSE 0 END) AS bid, sum(CASE WHEN side = 'ask' THEN quantity ELSE 0 END) AS ask FROM g GROUP BY 1, 2)
SELECT k, seq, {r(f"price - {lag('price', 1, KS)}")} AS price_diff, {r(f"price / {lag('price', 1, KS)} - 1")} AS price_pct, {r("ln(1 + quantity)")} AS quantity_log, {flag("pos <= 5")} AS is_top, {flag("pos > 20")} AS is_deep,
 {r("CASE WHEN side = 'bid' AND pos <= 5 THEN quantity / (pos + 1) ELSE 0 END")} AS bid_pressure, {r("CASE WHEN side = 'ask' AND pos <= 5 THEN quantity / (pos + 1) ELSE 0 END")} AS ask_pressure,
 {r(f"1 / (coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER ({KS})) / 1e6, 1) + 0.001)", 5)} AS update_rate, {r("(bid - ask) / (bid + ask)")} AS imbalance FROM g JOIN a ON k = gk AND b = gb""")
def _(spark, sf):
    q = v.quotes(spark, sf).withColumn("bucket", F.date_trunc("hour", "ts")).withColumn("position", F.col("seq") % 30)
    return bk.event_features(q).select("k", "seq", "is_top", "is_deep", rd("update_rate", 5).alias("update_rate"), *[rd(c).alias(c) for c in (
        "price_diff", "price_pct", "quantity_log", "bid_pressure", "ask_pressure", "imbalance")])


@query("b19_tick_against_book", f"""
WITH j AS (SELECT t.k, t.seq, t.price AS p, t.quantity AS q, CASE WHEN epoch_us(t.ts) - epoch_us(b.ts) <= 3600000000 THEN b.price END AS rp,
 CASE WHEN epoch_us(t.ts) - epoch_us(b.ts) <= 3600000000 THEN b.quantity END AS rq, CASE WHEN epoch_us(t.ts) - epoch_us(b.ts) <= 3600000000 THEN b.side END AS rs FROM trades_k t ASOF LEFT JOIN quotes b ON t.k = b.k AND t.ts >= b.ts)
SELECT k, seq, {r("(p - rp) / rp * 100")} AS price_vs_book, {flag("p > rp")} AS above_book, {flag("p < rp")} AS below_book, {r("q / (rq + 1)")} AS qty_vs_book,
 {flag("q > rq")} AS larger_than_book, {flag("rs = 'bid'")} AS matches_bid FROM j""")
def _(spark, sf):
    return bk.tick_against_book(v.trades_k(spark, sf), v.quotes(spark, sf), 3600).select(
        "k", "seq", rd("price_vs_book").alias("price_vs_book"), "above_book", "below_book", rd("qty_vs_book").alias("qty_vs_book"), "larger_than_book", "matches_bid")


@query("b20_top_series", f"""
WITH {RAW_TOPS}, a AS (SELECT *, ask - bid AS spread, (ask + bid) / 2 AS mid FROM tops), b AS (SELECT *, mid / {lag("mid", 1, K)} - 1 AS r1 FROM a)
SELECT k, ts, {r("spread")} AS spread, {r("mid")} AS mid, {r("(bid_qty - ask_qty) / (bid_qty + ask_qty)")} AS qty_imbalance, {r("bid_qty / (bid_qty + ask_qty)")} AS pressure, {r("r1")} AS ret_1,
 {r(f"mid / {lag('mid', 5, K)} - 1")} AS ret_5, {r(f"mid / {lag('mid', 10, K)} - 1")} AS ret_10, {r(std("r1", 10, part=K))} AS vol_10, {r(std("r1", 30, part=K))} AS vol_30,
 {r(mean("spread", 10, part=K))} AS spread_ma_10, {r(mean("bid_qty", 10, part=K))} AS bid_qty_10 FROM b""")
def _(spark, sf):
    return bk.top_series(tops(spark, sf)).select("k", "ts", *[rd(c).alias(c) for c in (
        "spread", "mid", "qty_imbalance", "pressure", "ret_1", "ret_5", "ret_10", "vol_10", "vol_30", "spread_ma_10", "bid_qty_10")])


@query("b21_liquidity_drop", f"""
WITH a AS (SELECT symbol, seq, {SCORE} AS sc FROM book_l2)
SELECT symbol, seq, {r("sc")} AS liquidity_score, {r(mean("sc", 10, part=SP))} AS mean_score, {flag(f"sc < {mean('sc', 10, part=SP)} * 0.9")} AS low_liquidity FROM a""")
def _(spark, sf):
    return bk.liquidity_drop(v.book_l2(spark, sf), 10, 0.9, depth=10).select(
        "symbol", "seq", rd("liquidity_score").alias("liquidity_score"), rd("mean_score").alias("mean_score"), "low_liquidity")
