"""Time bars and grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import aggregates as ag
from tickloom.operators import bars as br
from tickloom.operators.windows import by_time, last_rows, rmean
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r

ROLL20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("a01_a02_bars_microstructure", f"""
SELECT symbol, ts, open, high, low, close, volume, trades, buy_volume, sell_volume, buy_trades, sell_trades,
  {r("coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0)::DOUBLE, 0)")} AS imbalance,
  {r("volume / trades")} AS avg_trade_size,
  {r("CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END")} AS sma_20,
  {r("sum(turnover) OVER w20 / sum(volume) OVER w20")} AS vwap_20
FROM bars WINDOW w20 AS {ROLL20}""")
def _(spark, sf):
    b = v.bars(spark, sf)
    w = by_time("symbol")
    f = last_rows(w, 20)
    return b.select(
        "symbol", "ts", "open", "high", "low", "close", "volume", "trades", "buy_volume", "sell_volume",
        "buy_trades", "sell_trades",
        rd(br.imbalance(F.col("buy_volume"), F.col("sell_volume"))).alias("imbalance"),
        rd(F.col("volume") / F.col("trades")).alias("avg_trade_size"),
        rd(rmean(F.col("close"), w, 20)).alias("sma_20"),
        rd(F.sum("turnover").over(f) / F.sum("volume").over(f)).alias("vwap_20"))


@query("a03_resample_bars", """
SELECT symbol, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, ts) AS open,
  max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trades) AS BIGINT) AS trades
FROM bars b GROUP BY 1, 2""")
def _(spark, sf):
    return br.resample(v.bars(spark, sf), "4 hours")


@query("a03_day_bars", f"""
SELECT symbol, ts, open, high, low, close, volume, trades, {r("turnover", 2)} AS turnover FROM day_bars""")
def _(spark, sf):
    return v.day_bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume", "trades",
                                        rd("turnover", 2).alias("turnover"))


@query("a04_tick_rule_side", """
SELECT symbol, date_trunc('hour', ts) AS ts, CAST(sum(CASE WHEN up THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume,
  CAST(sum(CASE WHEN up THEN 0 ELSE quantity END) AS BIGINT) AS sell_volume,
  CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) AS BIGINT) AS buy_trades
FROM (SELECT *, coalesce(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) >= 0 AS up FROM ticks)
GROUP BY 1, 2""")
def _(spark, sf):
    return br.time_bars(ag.infer_side(v.ticks(spark, sf)), "1 hour").select(
        "symbol", "ts", "buy_volume", "sell_volume", "buy_trades")


TOPS = f"""
SELECT k, date_trunc('hour', ts) AS ts, arg_max(price, (ts, seq)) FILTER (side = 'bid') AS bid,
  arg_max(price, (ts, seq)) FILTER (side = 'ask') AS ask, {r("avg(quantity) FILTER (side = 'bid')")} AS bid_qty,
  {r("avg(quantity) FILTER (side = 'ask')")} AS ask_qty
FROM quotes GROUP BY 1, 2"""


@query("a05_book_tops", TOPS)
def _(spark, sf):
    return ag.book_tops(v.quotes(spark, sf), "1 hour").select(
        "k", "ts", "bid", "ask", rd("bid_qty").alias("bid_qty"), rd("ask_qty").alias("ask_qty"))


@query("a06_depth_by_side", f"""
SELECT k, side, date_trunc('day', ts)::TIMESTAMP AS ts, CAST(sum(quantity) AS BIGINT) AS qty_sum,
  {r("avg(quantity)")} AS qty_mean, count(*) AS qty_count, min(price) AS price_min, max(price) AS price_max,
  {r("stddev_samp(price)")} AS price_std FROM quotes GROUP BY 1, 2, 3""")
def _(spark, sf):
    return ag.depth_by_side(v.quotes(spark, sf), "1 day").withColumns(
        {"qty_mean": rd("qty_mean"), "price_std": rd("price_std")})


@query("a07_type_pivot", f"""
SELECT user_id % 10 AS k, date_trunc('hour', ts) AS ts, count(*) FILTER (event_type = 'view') AS "view",
  count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
  {r("count(*) FILTER (event_type = 'view') / (count(*) FILTER (event_type = 'click') + 1)")} AS update_ratio
FROM events GROUP BY 1, 2""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("k", F.col("user_id") % 10).withColumn(
        "hour", F.date_trunc("hour", "ts"))
    return ag.type_counts(e, ["k", "hour"], ["view", "click", "purchase"], "view", "click").select(
        "k", F.col("hour").alias("ts"), "view", "click", "purchase", rd("update_ratio").alias("update_ratio"))


@query("a08_top_agents", """
SELECT buy_agent, count(*) AS n FROM ticks GROUP BY 1 ORDER BY n DESC, buy_agent LIMIT 20""")
def _(spark, sf):
    return ag.top_values(v.ticks(spark, sf), "buy_agent", 20)


@query("a09_updates_per_bucket", """
SELECT symbol, seq, count(*) OVER (PARTITION BY symbol, date_trunc('hour', ts)) AS updates FROM ticks""")
def _(spark, sf):
    t = v.ticks(spark, sf).withColumn("bucket", F.date_trunc("hour", "ts"))
    return ag.attach_counts(t, ["symbol", "bucket"], "updates").select("symbol", "seq", "updates")


@query("a10_hour_distribution", f"""
SELECT hour, sum(n)::BIGINT AS n, {r("avg(n)")} AS mean_per_hour FROM
 (SELECT extract(hour FROM ts) AS hour, date_trunc('hour', ts) AS h, count(*) AS n FROM ticks GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    per = v.ticks(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.hour("h").cast("long").alias("hour")).agg(
        F.sum("n").alias("n"), rd(F.avg("n")).alias("mean_per_hour"))


@query("a11_hour_coverage", f"""
SELECT symbol, CAST(ts AS DATE) AS day, count(DISTINCT extract(hour FROM ts)) AS hours,
  {r("count(DISTINCT extract(hour FROM ts)) / 10")} AS coverage
FROM ticks WHERE extract(hour FROM ts) BETWEEN 9 AND 18 GROUP BY 1, 2""")
def _(spark, sf):
    t = v.ticks(spark, sf).where(F.hour("ts").between(9, 18))
    return t.groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.countDistinct(F.hour("ts")).alias("hours"),
        rd(F.countDistinct(F.hour("ts")) / 10.0).alias("coverage"))


@query("a12_trade_and_candle_stats", f"""
SELECT t.symbol, total_volume, avg_price, std_price, n, buy_ratio, avg_volume, avg_range, return_std FROM
 (SELECT symbol, CAST(sum(quantity) AS BIGINT) AS total_volume, {r("avg(price)")} AS avg_price,
    {r("stddev_samp(price)")} AS std_price, count(*) AS n,
    {r("avg(CASE WHEN side = 'buy' THEN 1 ELSE 0 END)")} AS buy_ratio FROM ticks GROUP BY 1) t
JOIN (SELECT symbol, {r("avg(volume)")} AS avg_volume, {r("avg(high - low)")} AS avg_range,
    {r("stddev_samp(ret)")} AS return_std FROM
    (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) GROUP BY 1) b
ON t.symbol = b.symbol""")
def _(spark, sf):
    t = v.ticks(spark, sf).groupBy("symbol").agg(
        F.sum("quantity").alias("total_volume"), rd(F.avg("price")).alias("avg_price"),
        rd(F.stddev_samp("price")).alias("std_price"), F.count(F.lit(1)).alias("n"),
        rd(F.avg((F.col("side") == "buy").cast("int"))).alias("buy_ratio"))
    b = v.bars(spark, sf).withColumn(
        "ret", F.col("close") / F.lag("close").over(by_time("symbol")) - 1).groupBy("symbol").agg(
        rd(F.avg("volume")).alias("avg_volume"), rd(F.avg(F.col("high") - F.col("low"))).alias("avg_range"),
        rd(F.stddev_samp("ret")).alias("return_std"))
    return t.join(b, "symbol")


@query("a15_p19_volume_profile", f"""
, edges AS (SELECT symbol AS s, min(price) AS lo, max(price) AS hi FROM ticks GROUP BY 1),
per AS (SELECT symbol, lo, hi, CAST(CASE WHEN hi > lo THEN least(greatest(ceil((price - lo) / (hi - lo) * 20), 1), 20) ELSE 1 END AS BIGINT) AS bin,
   sum(quantity) AS vol FROM ticks JOIN edges ON symbol = s GROUP BY 1, 2, 3, 4),
prof AS (SELECT symbol, lo, hi, arg_min(bin, (-vol, bin)) AS poc_bin, max(vol) AS pv, sum(vol) AS total,
   sum(vol::DOUBLE * vol) AS ss FROM per GROUP BY 1, 2, 3)
SELECT symbol, poc_bin, CAST(pv AS BIGINT) AS poc_volume, {r("pv / total")} AS poc_share,
  {r("lo + (poc_bin - 0.5) * (hi - lo) / 20")} AS poc_price,
  {r("(pv / total + 1 / (1 + exp(-(sqrt((ss - 20 * (total / 20) * (total / 20)) / 19) / (total / 20))))) / 2")} AS profile_score
FROM prof""".replace(", edges AS", "WITH edges AS", 1))
def _(spark, sf):
    return ag.volume_profile(v.ticks(spark, sf), 20).withColumns(
        {c: rd(c) for c in ("poc_share", "poc_price", "profile_score")})


@query("a16_p18_price_deciles", f"""
WITH q AS (SELECT symbol AS s, quantile_cont(close, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM bars GROUP BY 1),
d AS (SELECT symbol, ts, volume, len(list_filter(e, lambda x: close > x)) AS decile FROM bars JOIN q ON symbol = s)
SELECT symbol, ts, decile, {r("volume / avg(volume) OVER (PARTITION BY symbol, decile) - 1")} AS deviation FROM d""")
def _(spark, sf):
    return ag.price_deciles(v.bars(spark, sf)).withColumn("deviation", rd("deviation"))


@query("a17_slice_stats", f"""
WITH a AS (SELECT symbol, arg_max(price, (ts, seq)) AS lp, arg_min(price, (ts, seq)) AS fp, avg(price) AS mp,
  stddev_samp(price) AS sp, CAST(sum(quantity) AS BIGINT) AS total_volume, avg(quantity) AS mv, stddev_samp(quantity) AS sv
  FROM ticks GROUP BY 1)
SELECT symbol, lp AS last_price, {r("mp")} AS mean_price, {r("sp")} AS std_price, {r("lp - fp")} AS price_change,
 {r("(lp / fp - 1) * 100")} AS price_change_pct, total_volume, {r("mv")} AS mean_volume, {r("sv")} AS volume_std FROM a""")
def _(spark, sf):
    return ag.slice_stats(v.ticks(spark, sf)).withColumns(
        {c: rd(c) for c in ("mean_price", "std_price", "price_change", "price_change_pct", "mean_volume", "volume_std")})


@query("a18_large_trade_imbalance", f"""
WITH m AS (SELECT symbol AS s, median(quantity) AS med FROM ticks GROUP BY 1),
a AS (SELECT symbol, CAST(sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume,
  CAST(sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume
  FROM ticks JOIN m ON symbol = s WHERE quantity > med * 1.5 GROUP BY 1)
SELECT symbol, buy_volume, sell_volume,
 {r("coalesce((buy_volume - sell_volume) / nullif(buy_volume + sell_volume, 0), 0)")} AS imbalance FROM a""")
def _(spark, sf):
    return ag.large_trade_imbalance(v.ticks(spark, sf), 1.5).withColumn("imbalance", rd("imbalance"))


@query("a19_price_action_quality", f"""
WITH a AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER w AS pos, close / lag(close) OVER w - 1 AS ret FROM bars
  WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)),
b AS (SELECT *, CASE WHEN sign(ret) <> lag(sign(ret)) OVER (PARTITION BY symbol, day ORDER BY ts) THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT symbol, day, count(*) AS n, regr_slope(close, pos) AS slope, regr_r2(close, pos) AS r2,
  1 - sum(turn) / count(ret) AS smooth,
  CASE WHEN abs(avg(ret)) > 0 THEN 1 / (1 + stddev_samp(ret) / abs(avg(ret))) ELSE 0.5 END AS calm FROM b GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT symbol, day, n, {r("slope")} AS slope, {r("r2")} AS r2, {r("smooth")} AS smoothness,
 {r("(r2 + calm + smooth) / 3")} AS quality FROM c""")
def _(spark, sf):
    return ag.price_action_quality(v.bars(spark, sf)).withColumns(
        {c: rd(c) for c in ("slope", "r2", "smoothness", "quality")})


def _acc_sql(expr, name):
    return f"""SELECT {expr} AS {name}, count(*) AS n,
 {r("avg(CASE WHEN predicted = actual THEN 1 ELSE 0 END)")} AS accuracy, {r("avg(confidence)")} AS confidence
 FROM predictions GROUP BY 1"""


for _name, _spark, _sql in (
    ("hour", lambda: F.hour("ts").cast("long"), "extract(hour FROM ts)"),
    ("weekday", lambda: F.weekday("ts").cast("long"), "extract(isodow FROM ts) - 1"),
    ("week", lambda: F.date_trunc("week", "ts"), "date_trunc('week', ts)::TIMESTAMP"),
):
    def _acc(spark, sf, col=_spark, name=_name):
        return ag.accuracy_by(v.predictions(spark, sf), col(), name).withColumns(
            {"accuracy": rd("accuracy"), "confidence": rd("confidence")})
    query(f"a20_accuracy_by_{_name}", _acc_sql(_sql, _name))(_acc)


@query("a21_monthly_returns", f"""
WITH r AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM day_bars),
m AS (SELECT symbol, date_trunc('month', ts) AS month, exp(sum(ln(1 + ret))) - 1 AS m FROM r WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT symbol, count(*) AS months, CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive,
 CAST(sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, {r("max(m)")} AS best, {r("min(m)")} AS worst,
 {r("avg(m) / stddev_pop(m) * sqrt(12.0)")} AS sharpe FROM m GROUP BY 1""")
def _(spark, sf):
    return ag.monthly_returns(v.day_bars(spark, sf)).withColumns({c: rd(c) for c in ("best", "worst", "sharpe")})


CORR = ["open", "high", "low", "close", "volume"]


@query("a22_correlation_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr, CASE WHEN abs(corr({a}, {b})) > 0.95 THEN 1 ELSE 0 END AS redundant FROM bars"
    for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def _(spark, sf):
    return ag.correlation_pairs(v.bars(spark, sf), CORR).withColumn("corr", rd("corr"))


@query("a23_distinct_counts", """
SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT price) AS prices,
 count(DISTINCT buy_agent) AS agents FROM ticks GROUP BY 1""")
def _(spark, sf):
    return v.ticks(spark, sf).groupBy("symbol").agg(
        F.countDistinct(F.to_date("ts")).alias("days"), F.countDistinct("price").alias("prices"),
        F.countDistinct("buy_agent").alias("agents"))


@query("a24_trade_buffer", f"""
SELECT symbol, seq, {r("sum(price * quantity) OVER w / sum(quantity) OVER w")} AS vwap,
 {r("avg(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) OVER w")} AS aggressor_ratio,
 {r("count(*) OVER t / 7200")} AS intensity
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
 t AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECONDS PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return ag.trade_buffer(v.ticks(spark, sf), 20, 7200).withColumns(
        {"vwap": rd("vwap"), "aggressor_ratio": rd("aggressor_ratio"), "intensity": rd("intensity")})


@query("a24_candle_buffer", f"""
WITH a AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars)
SELECT symbol, ts, close AS last, max(high) OVER w AS high, min(low) OVER w AS low, {r("avg(volume) OVER w")} AS mean_volume,
 {r("ret")} AS ret, {r("CASE WHEN count(ret) OVER w >= 2 THEN stddev_pop(ret) OVER w END")} AS volatility
FROM a WINDOW w AS {ROLL20}""")
def _(spark, sf):
    return ag.candle_buffer(v.bars(spark, sf), 20).withColumns(
        {c: rd(c) for c in ("mean_volume", "ret", "volatility")})


@query("a25_metric_summary", f"""
SELECT metric, count(value) AS n, {r("avg(value)")} AS mean, min(value) AS min, max(value) AS max FROM
 (SELECT event_type || '_value' AS metric, value FROM events) GROUP BY 1""")
def _(spark, sf):
    e = v.table(spark, sf, "events").select(F.concat("event_type", F.lit("_value")).alias("metric"), "value")
    return e.groupBy("metric").agg(F.count("value").alias("n"), rd(F.avg("value")).alias("mean"),
                                   F.min("value").alias("min"), F.max("value").alias("max"))


STATS = ["open", "close", "volume", "buy_volume"]


@query("a26_feature_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS nulls, {r(f'avg({c})', 5)} AS mean, "
    f"{r(f'stddev_samp({c})', 5)} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM bars" for c in STATS))
def _(spark, sf):
    return ag.column_stats(v.bars(spark, sf), STATS).withColumns({"mean": rd("mean", 5), "std": rd("std", 5)})


@query("a27_prediction_windows", f"""
SELECT symbol, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS ts, count(*) AS n,
 {r("avg(confidence)")} AS mean_confidence, {r("stddev_samp(confidence)")} AS std_confidence,
 {r("avg(CASE WHEN predicted = 2 THEN 1 ELSE 0 END)")} AS bullish_ratio FROM predictions p GROUP BY 1, 2""")
def _(spark, sf):
    return v.predictions(spark, sf).groupBy("symbol", F.window("ts", "6 hours").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("confidence")).alias("mean_confidence"),
        rd(F.stddev_samp("confidence")).alias("std_confidence"),
        rd(F.avg((F.col("predicted") == 2).cast("int"))).alias("bullish_ratio")).select(
        "symbol", F.col("w.start").alias("ts"), "n", "mean_confidence", "std_confidence", "bullish_ratio")


@query("a28_volume_pace", f"""
SELECT symbol, ts, volume AS pace, {r("CASE WHEN count(*) OVER w5 >= 5 THEN avg(volume) OVER w5 END")} AS pace_5,
 {r("CASE WHEN count(*) OVER w15 >= 10 THEN (avg(volume) OVER w5 / avg(volume) OVER w15 - 1) * 100 END")} AS acceleration
FROM bars WINDOW w5 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
 w15 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING)""")
def _(spark, sf):
    return ag.volume_pace(v.bars(spark, sf)).withColumns({"pace_5": rd("pace_5"), "acceleration": rd("acceleration")})


@query("a29_model_metrics", f"""
SELECT symbol AS model, count(*) AS n, {r("avg(confidence)")} AS confidence, {r("avg(quantity)")} AS latency
FROM predictions JOIN (SELECT seq AS s, quantity FROM ticks) ON seq = s GROUP BY 1""")
def _(spark, sf):
    t = v.ticks(spark, sf).select(F.col("seq").alias("s"), "quantity")
    return v.predictions(spark, sf).join(t, F.col("seq") == F.col("s")).groupBy(F.col("symbol").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("confidence")).alias("confidence"), rd(F.avg("quantity")).alias("latency"))


@query("a30_daily_by_regime", f"""
SELECT regime, CAST(exit_ts AS DATE) AS day, count(*) AS trades, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
 {r("sum(pnl)", 4)} AS pnl FROM closed_trades GROUP BY 1, 2""")
def _(spark, sf):
    return v.closed_trades(spark, sf).groupBy("regime", F.to_date("exit_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum((F.col("pnl") > 0).cast("int")).alias("wins"),
        rd(F.sum("pnl"), 4).alias("pnl"))
