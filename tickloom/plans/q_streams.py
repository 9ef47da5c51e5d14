"""Streaming jobs (ST01-ST13), stream sinks (S13, S18), user functions (U01-U05) and the feature vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as br, rolling as ro, userfn, vector
from tickloom.operators.windows import by_time, rmean
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import PART, W, flag, fr, lag, mean, std, total
from tickloom.session import scratch_path
from tickloom.streaming import jobs


def stream(spark, sf, files=None):
    """The events table as a stream of ticks; as ``files`` time-ordered files when given."""
    t = v.ticks(spark, sf)
    if files:
        return jobs.replay(t, files, ["ts", "seq"])
    raw = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(raw).parquet(f"{sf}/events*.parquet")
    return _ticks(e.withColumn("ts", F.col("ts").cast("timestamp")))


def _ticks(e):
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.round(F.lit(100.0) + F.col("value"), 2).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, "buy").when(F.col("event_id") % 3 == 1, "sell").otherwise("auction").alias("side"))


CLOSED = "(SELECT max(ts) - INTERVAL 5 MINUTE FROM ticks)"
COLS = "symbol, ts, open, high, low, close, volume, trades"


@query("st01_closed_candles", f"SELECT {COLS} FROM bars WHERE ts + INTERVAL 1 HOUR <= {CLOSED}")
def _(spark, sf):
    return jobs.drain(jobs.candles(stream(spark, sf), "1 hour")).select(*COLS.split(", "))


@query("st02_all_candles", f"SELECT {COLS} FROM bars")
def _(spark, sf):
    return jobs.all_candles(stream(spark, sf), "1 hour").select(*COLS.split(", "))


for _name, _files in (("st03_late_rule", 1), ("st03_late_rule_batches", 5)):
    def _late(spark, sf, files=_files):
        t = v.ticks(spark, sf).withColumns({"arrival": F.col("seq") * 7919 % 10007, "live": F.col("seq") % 2 == 1})
        s = jobs.replay(t, files, ["arrival", "seq"])
        return jobs.late_split(s, 864000, ["arrival", "seq"]).select("symbol", "seq", "rejected")
    query(_name, f"SELECT symbol, seq, {flag('seq % 2 = 1 AND epoch_us(max(ts) OVER (ORDER BY seq * 7919 % 10007, seq)) - epoch_us(ts) > 864000000000')} AS rejected FROM ticks")(_late)


@query("st04_sliding_ofi", f"""
WITH w AS (SELECT symbol, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS s, side, quantity FROM ticks, range(0, 3) r(k)),
a AS (SELECT symbol, s AS ts, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS b, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS x FROM w GROUP BY 1, 2)
SELECT symbol, ts, {r("coalesce((b - x) / nullif(b + x, 0), 0)")} AS ofi FROM a WHERE ts + INTERVAL 6 HOUR <= {CLOSED}""")
def _(spark, sf):
    return jobs.drain(jobs.sliding_ofi(stream(spark, sf), "6 hours", "2 hours")).withColumn("ofi", rd("ofi"))


@query("st05_running_state", """
SELECT symbol, CAST(sum(CASE side WHEN 'buy' THEN quantity WHEN 'sell' THEN -quantity ELSE 0 END) AS BIGINT) AS cvd, count(*) AS trades, arg_max(price, (ts, seq)) AS last_price, max(ts) AS last_ts FROM ticks GROUP BY 1""")
def _(spark, sf):
    return jobs.running_state(stream(spark, sf, 3))


@query("st06_ring_buffer", "SELECT symbol, ts, seq, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 50")
def _(spark, sf):
    return jobs.ring_buffer(stream(spark, sf, 3), 50).select("symbol", "ts", "seq", "price")


@query("st07_coordinated_signals", f"""
SELECT date_trunc('hour', ts) AS ts, count(*) AS n, CAST(sum(CASE WHEN action = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buys, {r("avg(confidence)")} AS confidence FROM agent_signals g GROUP BY 1
HAVING count(*) >= 12 AND date_trunc('hour', min(g.ts)) + INTERVAL 1 HOUR <= {CLOSED}""")
def _(spark, sf):
    s = stream(spark, sf).select("ts", F.when(F.col("side") == "buy", "buy").when(F.col("side") == "sell", "sell").otherwise("hold").alias("action"),
                                 F.least(F.round(F.col("price") - 100, 2) / 300.0, F.lit(1.0)).alias("confidence"))
    return jobs.drain(jobs.coordinated(s, "1 hour", 12)).withColumn("confidence", rd("confidence"))


@query("st08_decision_fill_join", """
SELECT o_orderkey AS id, o_orderdate AS decided, l_shipdate AS filled, l_quantity AS quantity, l_extendedprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 120 DAY""")
def _(spark, sf):
    one = lambda n: spark.readStream.schema(spark.read.parquet(f"{sf}/{n}.parquet").schema).parquet(f"{sf}/{n}*.parquet")
    v.table(spark, sf, "orders")
    d = one("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("decided"))
    f = one("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("filled"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return jobs.drain(jobs.decisions_with_fills(d, f, "120 DAYS"))


@query("st09_feature_refresh", f"""
WITH d AS (SELECT symbol, CAST(ts AS DATE)::TIMESTAMP AS ts, arg_max(price, (ts, seq)) AS close FROM ticks t GROUP BY 1, 2)
SELECT symbol, ts, close, {r(mean("close", 3))} AS sma_3 FROM d""")
def _(spark, sf):
    feature = lambda b: b.select("symbol", "ts", "close", rmean(F.col("close"), by_time("symbol"), 3).alias("sma_3"))
    return jobs.refresh_features(stream(spark, sf, 3), "1 day", 4, feature).select("symbol", "ts", "close", rd("sma_3").alias("sma_3"))


@query("st10_progress", "SELECT 3::BIGINT AS batches, count(*) AS input_rows, 1 AS timed, 1 AS flows FROM ticks")
def _(spark, sf):
    out, log = scratch_path(spark, "progress"), scratch_path(spark, "progress-log")
    jobs.drain_each(stream(spark, sf, 3), jobs.metered(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), log))
    return jobs.progress(spark, log).select("batches", "input_rows", (F.col("longest_seconds") >= F.col("mean_seconds")).cast("int").alias("timed"),
                                            (F.col("rows_per_second") > 0).cast("int").alias("flows"))


@query("st11_catch_up_then_live", f"""
WITH a AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'history' ELSE 'live' END AS phase, * FROM ticks)
SELECT phase, count(*) AS rows, {r("(epoch_us(min(ts)) - epoch_us((SELECT max(ts) FROM a WHERE phase = 'history'))) / 1e6")} AS gap FROM a GROUP BY 1""")
def _(spark, sf):
    out = scratch_path(spark, "catch-up")
    t = v.ticks(spark, sf)
    cut = F.lit("2024-01-20").cast("timestamp")
    jobs.catch_up(spark, t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut), out)
    got = spark.read.parquet(out).withColumn("phase", F.when(F.col("ts") < cut, "history").otherwise("live"))
    end = got.where("phase = 'history'").agg(F.max("ts").alias("end"))
    return got.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first")).crossJoin(F.broadcast(end)).select(
        "phase", "rows", rd((F.unix_micros("first") - F.unix_micros("end")) / 1e6).alias("gap"))


@query("st12_replay", f"SELECT {COLS} FROM bars")
def _(spark, sf):
    return jobs.all_candles(stream(spark, sf, 4), "1 hour").select(*COLS.split(", "))


@query("st13_candidate_model", f"""
WITH a AS (SELECT *, buy_agent % 3 AS candidate FROM (SELECT p.*, t.buy_agent FROM predictions p JOIN (SELECT seq AS s, buy_agent FROM ticks) t ON p.seq = t.s) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 500)
SELECT symbol, count(*) AS n, {r("avg(CASE WHEN predicted = actual THEN 1 ELSE 0 END)")} AS current, {r("avg(CASE WHEN candidate = actual THEN 1 ELSE 0 END)")} AS candidate,
 {flag("avg(CASE WHEN candidate = actual THEN 1.0 ELSE 0 END) > avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0 END) * 1.02")} AS switch FROM a GROUP BY 1""")
def _(spark, sf):
    c = v.ticks(spark, sf).select("seq", (F.col("buy_agent") % 3).alias("candidate"))
    return jobs.better_model(v.predictions(spark, sf).join(c, "seq"), "predicted", "candidate", 500, 0.02).withColumns({"current": rd("current"), "candidate": rd("candidate")})


@query("s13_live_ingestion", "SELECT symbol, ts, seq, price, quantity, side FROM ticks")
def _(spark, sf):
    return jobs.drain(stream(spark, sf))


@query("s18_flush_by_date_and_type", "SELECT symbol AS type, CAST(ts AS DATE) AS date, count(*) AS rows FROM ticks GROUP BY 1, 2")
def _(spark, sf):
    s = stream(spark, sf, 2).withColumns({"date": F.to_date("ts"), "type": F.col("symbol")})
    return jobs.drain(s, parts=["date", "type"]).groupBy("type", "date").agg(F.count(F.lit(1)).alias("rows"))


@query("u01_u05_user_feature", f"SELECT symbol, seq, {r('CASE WHEN count(*) OVER w >= 20 THEN avg(price) OVER w END')} AS feature FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(spark, sf):
    from pyspark.sql import types as T
    o = ro.layout(v.ticks(spark, sf))
    out = userfn.per_chunk(o, lambda p: p["price"].rolling(20).mean(), "feature", T.DoubleType(), 19, ["symbol", "seq"])
    return out.select("symbol", "seq", rd(F.nanvl("feature", F.lit(None).cast("double"))).alias("feature"))


@query("u02_u03_user_group_function", f"SELECT symbol, day, {r('max(close) / min(close) - 1')} AS span FROM (SELECT symbol, CAST(ts AS DATE) AS day, close FROM bars WHERE trades > 1) GROUP BY 1, 2")
def _(spark, sf):
    b = userfn.where_all(v.bars(spark, sf), {"busy": lambda d: d["trades"] > 1}).select("symbol", F.to_date("ts").alias("day"), "close")
    fn = lambda p: p.groupby(["symbol", "day"], as_index=False)["close"].agg(span=lambda x: x.max() / x.min() - 1)
    return userfn.per_group(b, ["symbol", "day"], fn, "symbol string, day date, span double").withColumn("span", rd("span"))


def _vector_sql():
    tops = {s: f"(SELECT {c} FROM ticks GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 5)" for s, c in (("buyer", "buy_agent"), ("seller", "sell_agent"))}
    act = ", ".join(f"max(CASE WHEN {c} = (SELECT {c} FROM ticks GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1 OFFSET {i}) THEN 1 ELSE 0 END)::DOUBLE AS top_{s}_{i}_active"
                    for s, c in (("buyer", "buy_agent"), ("seller", "sell_agent")) for i in range(5))
    e = {f"volatility_{n}": f"coalesce(v{n}, 0)" for n in (10, 20, 50, 100)}
    e |= {f"volatility_ratio_{a}_{b}": f"coalesce(v{a} / nullif(v{b}, 0), 1)" for a, b in ((10, 20), (20, 50), (50, 100), (100, 200))}
    e["volatility_gk"] = f"coalesce(sqrt(greatest({mean('gk', 20)}, 0)), 0)" .replace("greatest(", f"CASE WHEN {mean('gk', 20)} IS NOT NULL THEN greatest(").replace(", 0)), 0)", ", 0) END), 0)")
    e["bb_position"] = f"coalesce((close - m20) / nullif(2 * stddev_pop(close) OVER {fr(20)}, 0), 0)"
    e |= {f"returns_{n}": f"coalesce(close / {lag('close', n)} - 1, 0)" for n in (1, 2, 5, 10, 20, 50, 100)}
    e |= {f"log_returns_{n}": f"coalesce(ln(close / {lag('close', n)}), 0)" for n in (1, 5, 20)}
    e |= {f"order_flow_imbalance_{n}": f"coalesce({total('sv', n)} / nullif({total('tv', n)}, 0), 0)" for n in (10, 20, 50, 100)}
    e |= {"cumulative_signed_volume": f"sum(sv) OVER {W}", "signed_volume": "sv", "volume_weighted_return": f"coalesce(ret * volume / {mean('volume', 20)}, 0)", "agent_turnover": "turn"}
    e |= {f"volume_ratio_{n}": f"coalesce(volume / {mean('volume', n)}, 0)" for n in (20, 50, 100)}
    e |= {f"volume_zscore_{n}": f"CASE WHEN {std('volume', n)} IS NULL THEN 0 ELSE (volume - {mean('volume', n)}) / greatest({std('volume', n)}, 0.001) END" for n in (20, 50, 100)}
    e |= {"trade_intensity": "trades", "trade_intensity_ratio": f"coalesce(trades / {mean('trades', 20)}, 0)", "ma_5_20_ratio": "coalesce((m5 / m20 - 1) * 100, 0)", "ma_20_50_ratio": "coalesce((m20 / m50 - 1) * 100, 0)",
          "momentum_5_20": "coalesce(m5 / m20 - 1, 0)", "momentum_20_50": "coalesce(m20 / m50 - 1, 0)",
          "sharpe_5": f"CASE WHEN v10 IS NULL THEN 0 ELSE (close / {lag('close', 5)} - 1) / greatest(v10, 0.0001) END", "sharpe_20": f"CASE WHEN v50 IS NULL THEN 0 ELSE (close / {lag('close', 20)} - 1) / greatest(v50, 0.0001) END",
          "time_normalized": "least(greatest((mi - 540) / 480.0, 0), 1)",
          "rsi_14": f"coalesce(100 - 100 / (1 + {mean('gain', 14)} / (CASE WHEN {mean('loss', 14)} = 0 THEN 1e-10 ELSE {mean('loss', 14)} END)), 50)"}
    e |= {f"top_{s}_{i}_active": f"top_{s}_{i}_active" for s in ("buyer", "seller") for i in range(5)}
    e |= {"top_buyers_count": "tbc", "top_sellers_count": "tsc", "buyer_changed": f"coalesce(CAST(lb <> {lag('lb')} AS INT), 0)", "seller_changed": f"coalesce(CAST(ls <> {lag('ls')} AS INT), 0)",
          "is_buyer_aggressor": flag("sd = 'buy'"), "minute": "mi % 60", "hour": "floor(mi / 60)", "day_of_week": "extract(isodow FROM ts) - 1", "is_opening_30min": flag("mi BETWEEN 540 AND 569"),
          "is_closing_30min": flag("mi BETWEEN 1050 AND 1080"), "is_lunch_hour": flag("mi BETWEEN 720 AND 839")}
    pop = ", ".join(f"CASE WHEN count(ret) OVER {fr(n - 1)} >= {n - 1} THEN stddev_pop(ret) OVER {fr(n - 1)} END AS v{n}" for n in (10, 20, 50, 100, 200))
    return f"""
WITH u AS (SELECT symbol AS us, date_trunc('hour', ts) AS uts, {act}, sum(CASE WHEN buy_agent IN {tops['buyer']} THEN 1 ELSE 0 END) AS tbc, sum(CASE WHEN sell_agent IN {tops['seller']} THEN 1 ELSE 0 END) AS tsc,
 count(DISTINCT buy_agent) / count(*) AS turn, arg_max(buy_agent, (ts, seq)) AS lb, arg_max(sell_agent, (ts, seq)) AS ls, arg_max(side, (ts, seq)) AS sd FROM ticks t GROUP BY 1, 2),
b AS (SELECT *, buy_volume - sell_volume AS sv, buy_volume + sell_volume AS tv, 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2) AS gk, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS mi,
 {pop}, {mean("close", 5)} AS m5, {mean("close", 20)} AS m20, {mean("close", 50)} AS m50 FROM barx JOIN u ON us = symbol AND uts = ts)
SELECT symbol, ts, """ + ", ".join(f"{r(e[n])} AS {n}" for n in vector.names()) + " FROM b"


@query("t32_feature_vector", _vector_sql())
def _(spark, sf):
    return vector.feature_vector(v.ticks(spark, sf), "1 hour").select("symbol", "ts", *[rd(n).alias(n) for n in vector.names()])
