"""Joins (J01-J19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregates as ag, joins as jo
from tickloom.plans import views as v
from tickloom.plans.q_aggregates import TOPS
from tickloom.plans.registry import query, rd, rsql as r

ASOF = """FROM (SELECT * FROM quotes) q ASOF LEFT JOIN trades_k t ON q.k = t.k AND q.ts >= t.ts"""


@query("j01_asof_backward", f"SELECT q.k, q.seq, q.side, t.price AS r_price, t.quantity AS r_quantity {ASOF}")
def _(spark, sf):
    return jo.asof(v.quotes(spark, sf), v.trades_k(spark, sf), ["k"], ["price", "quantity"]).select(
        "k", "seq", "side", "r_price", "r_quantity")


@query("j02_asof_tolerance", f"""
SELECT q.k, q.seq, CASE WHEN epoch_us(q.ts) - epoch_us(t.ts) <= 1800000000 THEN t.price END AS r_price,
 {r("CASE WHEN epoch_us(q.ts) - epoch_us(t.ts) <= 1800000000 THEN (epoch_us(q.ts) - epoch_us(t.ts)) / 1e6 END")} AS r_gap {ASOF}""")
def _(spark, sf):
    return jo.asof(v.quotes(spark, sf), v.trades_k(spark, sf), ["k"], ["price"], tolerance=1800).select(
        "k", "seq", "r_price", rd("r_gap").alias("r_gap"))


@query("j03_asof_nearest", f"""
WITH b AS (SELECT q.k, q.seq, q.ts, t.ts AS bt, t.price AS bp FROM (SELECT * FROM quotes WHERE side = 'bid') q ASOF LEFT JOIN (SELECT * FROM quotes WHERE side = 'ask') t ON q.k = t.k AND q.ts >= t.ts),
f AS (SELECT q.seq AS s, t.ts AS ft, t.price AS fp FROM (SELECT * FROM quotes WHERE side = 'bid') q ASOF LEFT JOIN (SELECT * FROM quotes WHERE side = 'ask') t ON q.k = t.k AND q.ts <= t.ts),
c AS (SELECT *, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts)) THEN bp ELSE fp END AS p,
 least(coalesce(epoch_us(ts) - epoch_us(bt), 1e18), coalesce(epoch_us(ft) - epoch_us(ts), 1e18)) AS gap FROM b JOIN f ON seq = s)
SELECT k, seq, CASE WHEN gap <= 1200000000 THEN p END AS r_price FROM c""")
def _(spark, sf):
    q = v.quotes(spark, sf)
    return jo.asof(q.where("side = 'bid'"), q.where("side = 'ask'"), ["k"], ["price"], direction="nearest",
                   tolerance=1200).select("k", "seq", "r_price")


@query("j04_reindex_ffill", """
SELECT b.symbol, b.ts, b.close, c.close AS r_close, c.ts AS r_ts FROM bars b ASOF LEFT JOIN
 (SELECT symbol, ts + INTERVAL 5 MINUTE AS ts, close FROM bars WHERE trades > 2) c ON b.symbol = c.symbol AND b.ts >= c.ts""")
def _(spark, sf):
    b = v.bars(spark, sf).withColumn("seq", F.lit(0))
    c = b.where("trades > 2").select("symbol", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), "close", "seq")
    return jo.asof(b, c, ["symbol"], ["close", "ts"]).select("symbol", "ts", "close", "r_close", "r_ts")


@query("j05_left_ffill_zero", """
SELECT b.symbol, b.ts, b.close, coalesce(last_value(m.buy_volume IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS buy_volume
FROM bars b LEFT JOIN (SELECT symbol, ts, buy_volume FROM bars WHERE buy_trades > 0) m ON b.symbol = m.symbol AND b.ts = m.ts""")
def _(spark, sf):
    b = v.bars(spark, sf)
    return jo.join_filled(b.select("symbol", "ts", "close"), b.where("buy_trades > 0").select("symbol", "ts", "buy_volume"),
                          ["symbol", "ts"], ["buy_volume"], "left", zero=True)


@query("j06_inner_aligned_tail", """
SELECT b.symbol, b.ts, b.close, m.buy_volume FROM bars b JOIN bars m ON b.symbol = m.symbol AND b.ts = m.ts
WHERE b.trades > 1 AND m.buy_trades > 0 QUALIFY row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts DESC) <= 200""")
def _(spark, sf):
    b = v.bars(spark, sf)
    return jo.align_inner([b.where("trades > 1").select("symbol", "ts", "close"),
                           b.where("buy_trades > 0").select("symbol", "ts", "buy_volume")], ["symbol", "ts"], 200)


@query("j07_inner_or_full", """
, a AS (SELECT symbol, ts, close FROM bars WHERE extract(hour FROM ts) % 2 = 0), m AS (SELECT symbol, ts, buy_volume FROM bars WHERE extract(hour FROM ts) % 2 = 1)
SELECT coalesce(a.symbol, m.symbol) AS symbol, coalesce(a.ts, m.ts) AS ts, a.close,
 last_value(m.buy_volume IGNORE NULLS) OVER (PARTITION BY coalesce(a.symbol, m.symbol) ORDER BY coalesce(a.ts, m.ts) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS buy_volume
FROM a FULL JOIN m ON a.symbol = m.symbol AND a.ts = m.ts""".replace(", a AS", "WITH a AS", 1))
def _(spark, sf):
    b = v.bars(spark, sf)
    return jo.inner_or_full(b.where(F.hour("ts") % 2 == 0).select("symbol", "ts", "close"),
                            b.where(F.hour("ts") % 2 == 1).select("symbol", "ts", "buy_volume"), ["symbol", "ts"], ["buy_volume"])


@query("j08_full_outer_tables", """
SELECT symbol, ts, c.close AS candles_close, m.buy_volume AS micro_buy_volume, d.trades AS book_trades
FROM (SELECT symbol, ts, close FROM bars WHERE trades > 1) c FULL JOIN (SELECT symbol, ts, buy_volume FROM bars WHERE buy_trades > 0) m USING (symbol, ts)
FULL JOIN (SELECT symbol, ts, trades FROM bars WHERE sell_trades > 0) d USING (symbol, ts)""")
def _(spark, sf):
    b = v.bars(spark, sf)
    return jo.full_outer({"candles": b.where("trades > 1").select("symbol", "ts", "close"),
                          "micro": b.where("buy_trades > 0").select("symbol", "ts", "buy_volume"),
                          "book": b.where("sell_trades > 0").select("symbol", "ts", "trades")}, ["symbol", "ts"])


@query("j09_two_sided_buckets", f"SELECT * FROM ({TOPS}) WHERE bid IS NOT NULL AND ask IS NOT NULL")
def _(spark, sf):
    return ag.book_tops(v.quotes(spark, sf), "1 hour", both=True).withColumns(
        {"bid_qty": rd("bid_qty"), "ask_qty": rd("ask_qty")})


@query("j10_anti_missing", """
SELECT symbol, ts FROM bars b WHERE NOT EXISTS (SELECT 1 FROM (SELECT symbol AS s, ts AS t FROM bars WHERE buy_trades > 0) m WHERE m.s = b.symbol AND m.t = b.ts)""")
def _(spark, sf):
    b = v.bars(spark, sf)
    return b.join(b.where("buy_trades > 0").select("symbol", "ts"), ["symbol", "ts"], "left_anti").select("symbol", "ts")


@query("j11_semi_conflicts", """
SELECT symbol, ts, seq, price FROM source_b b WHERE EXISTS (SELECT 1 FROM source_a a WHERE a.symbol = b.symbol AND a.ts = b.ts)""")
def _(spark, sf):
    return v.source_b(spark, sf).join(v.source_a(spark, sf), ["symbol", "ts"], "left_semi").select("symbol", "ts", "seq", "price")


@query("j12_group_back_to_rows", f"""
WITH g AS (SELECT *, date_trunc('hour', ts) AS b FROM quotes),
a AS (SELECT k AS gk, b AS gb, sum(CASE WHEN side = 'bid' THEN quantity ELSE 0 END) AS bid, sum(CASE WHEN side = 'ask' THEN quantity ELSE 0 END) AS ask,
 coalesce(avg(quantity) FILTER (side = 'bid'), 0) AS mb, coalesce(avg(quantity) FILTER (side = 'ask'), 0) AS ma, count(*) AS updates FROM g GROUP BY 1, 2)
SELECT k, seq, {r("(bid - ask) / (bid + ask)")} AS imbalance, {r("bid / (bid + ask)")} AS bid_ratio, {r("(mb - ma) / (mb + ma + 1)")} AS size_imbalance, updates
FROM g JOIN a ON k = gk AND b = gb""")
def _(spark, sf):
    q = v.quotes(spark, sf).withColumn("b", F.date_trunc("hour", "ts"))
    return jo.attach_flow(q, ["k", "b"]).select(
        "k", "seq", *[rd(c).alias(c) for c in ("imbalance", "bid_ratio", "size_imbalance")], "updates")


@query("j13_recent_book_rows", """
SELECT t.k, t.seq, CAST(coalesce(sum(q.quantity) FILTER (q.side = 'bid'), 0) AS BIGINT) AS bid_volume,
 CAST(coalesce(sum(q.quantity) FILTER (q.side = 'ask'), 0) AS BIGINT) AS ask_volume, count(q.seq) AS updates
FROM trades_k t LEFT JOIN quotes q ON q.k = t.k AND q.ts <= t.ts AND q.ts >= t.ts - INTERVAL 7200 SECONDS GROUP BY 1, 2""")
def _(spark, sf):
    q = F.col("quantity")
    return jo.recent(v.trades_k(spark, sf), v.quotes(spark, sf), ["k"], 7200, {
        "bid_volume": F.when(F.col("side") == "bid", q), "ask_volume": F.when(F.col("side") == "ask", q),
        "updates": F.lit(1).cast("long")}).select("k", "seq", "bid_volume", "ask_volume", "updates")


@query("j14_near_marked_rows", """
SELECT symbol, seq FROM (SELECT symbol, seq, max(CASE WHEN price > 380 THEN 1 ELSE 0 END) OVER
 (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS m FROM ticks) WHERE m = 1""")
def _(spark, sf):
    return jo.near_marked(v.ticks(spark, sf), ["symbol"], ["ts", "seq"], F.col("price") > 380, 25).select("symbol", "seq")


@query("j15_q04_reconcile", f"""
WITH t AS (SELECT symbol AS s, date_trunc('hour', ts) AS h, max(price) AS hi, min(price) AS lo, sum(quantity) AS vol FROM dirty_ticks WHERE price > 0 GROUP BY 1, 2),
j AS (SELECT b.symbol, b.ts, t.s IS NOT NULL AS found, coalesce(abs(t.hi - b.high) / b.high <= 0.01 AND abs(t.lo - b.low) / b.low <= 0.01, false) AS price_ok,
 coalesce(abs(t.vol - b.volume) / b.volume <= 0.1, false) AS volume_ok FROM bars b LEFT JOIN t ON t.s = b.symbol AND t.h = b.ts)
SELECT symbol, count(*) AS bars, CAST(sum(CAST(found AS INT)) AS BIGINT) AS matched, CAST(sum(CAST(price_ok AS INT)) AS BIGINT) AS price_ok,
 CAST(sum(CAST(volume_ok AS INT)) AS BIGINT) AS volume_ok, {r("sum(CASE WHEN price_ok AND volume_ok THEN 1 ELSE 0 END) / count(*)")} AS score FROM j GROUP BY 1""")
def _(spark, sf):
    from tickloom.operators import quality
    return quality.reconcile(v.dirty_ticks(spark, sf).where("price > 0"), v.bars(spark, sf), "1 hour", 0.01, 0.1
                             ).withColumn("score", rd("score"))


@query("j17_d12_decision_execution", f"""
SELECT o_orderkey AS id, o_orderpriority AS priority, count(*) AS fills, CAST(sum(l_quantity) AS BIGINT) AS quantity,
 {r("sum(l_extendedprice)", 2)} AS notional, min(l_shipdate) AS first_fill
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("fills"), F.sum("l_quantity").cast("long").alias("quantity"),
        rd(F.sum("l_extendedprice"), 2).alias("notional"), F.min("l_shipdate").alias("first_fill"))
    o = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return o.join(li, "id").select("id", "priority", "fills", "quantity", "notional", "first_fill")


@query("j18_flow_context", """
SELECT d.symbol, d.seq, c.ts AS r_ts, c.volume AS r_volume FROM (SELECT * FROM ticks WHERE side = 'buy') d ASOF LEFT JOIN
 (SELECT symbol, ts + INTERVAL 1 HOUR AS ts, volume FROM bars) c ON d.symbol = c.symbol AND d.ts >= c.ts""")
def _(spark, sf):
    ctx = v.bars(spark, sf).select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), "volume", F.lit(0).cast("long").alias("seq"))
    return jo.asof(v.ticks(spark, sf).where("side = 'buy'"), ctx, ["symbol"], ["ts", "volume"]).select(
        "symbol", "seq", "r_ts", "r_volume")


@query("j19_top_agent_flag", """
WITH top AS (SELECT buy_agent AS a, count(*) AS n FROM ticks GROUP BY 1 ORDER BY n DESC, a LIMIT 10)
SELECT seq, CASE WHEN buy_agent IN (SELECT a FROM top) THEN 1 ELSE 0 END AS top_buyer FROM ticks""")
def _(spark, sf):
    t = v.ticks(spark, sf)
    return jo.flag_members(t, "buy_agent", ag.top_values(t, "buy_agent", 10), "top_buyer").select("seq", "top_buyer")
