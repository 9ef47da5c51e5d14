"""Projections, filters, predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import columns as fc
from tickloom.operators import cleaning as cl
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import flag


@query("p01_date_range", """
SELECT symbol, ts, seq, price FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""")
def _(spark, sf):
    return v.ticks(spark, sf).where(F.col("ts").between(
        F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("symbol", "ts", "seq", "price")


@query("p02_type_list", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('view', 'purchase')")
def _(spark, sf):
    return v.table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase")).select(
        "event_id", "event_type", "value")


@query("p03_seeded_sample", "SELECT seq, symbol FROM ticks ORDER BY md5(CAST(seq AS VARCHAR)), seq LIMIT 500")
def _(spark, sf):
    return cl.sample_rows(v.ticks(spark, sf), "seq", 500).select("seq", "symbol")


@query("p04_alias_mapping", "SELECT seq, price AS close, quantity AS volume FROM ticks")
def _(spark, sf):
    t = v.ticks(spark, sf).withColumnsRenamed({"price": "preco", "quantity": "qtd"})
    return cl.rename_aliases(t, {"preco": "close", "qtd": "volume", "fechamento": "close"}).select("seq", "close", "volume")


@query("p05_coercion", """
SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number,
 try_cast(CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS at FROM events""")
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumns({
        "raw": F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")),
        "raw_ts": F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))})
    return e.select("event_id", F.col("raw").try_cast("double").alias("number"),
                    F.try_to_timestamp("raw_ts", F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"))


@query("p06_p07_price_and_quantity_limits", """
SELECT symbol, seq, copy, price FROM dirty_ticks WHERE NOT (symbol = 'view' AND price < 110)
 AND price > 0 AND price < 10000 AND quantity > 0 AND quantity < 10000""")
def _(spark, sf):
    t = v.dirty_ticks(spark, sf)
    bad = (F.col("symbol") == "view") & (F.col("price") < 110)
    return t.where(~bad & (F.col("price") > 0) & (F.col("price") < 10000) & F.col("quantity").between(1, 9999)).select(
        "symbol", "seq", "copy", "price")


@query("p08_trade_validity", """
SELECT seq, copy, CASE WHEN price IS NULL THEN 'missing' WHEN NOT price > 0 THEN 'price' WHEN NOT quantity >= 0 THEN 'volume'
 WHEN side NOT IN ('buy', 'sell') THEN 'side' END AS reason FROM dirty_ticks""")
def _(spark, sf):
    return cl.split_valid(v.dirty_ticks(spark, sf), {
        "missing": F.col("price").isNotNull() & F.col("ts").isNotNull(), "price": F.col("price") > 0,
        "volume": F.col("quantity") >= 0, "side": F.col("side").isin("buy", "sell")}).select("seq", "copy", "reason")


BROKEN = """(SELECT symbol, ts, open, CASE WHEN trades % 3 = 0 THEN low - 1 ELSE high END AS high, low, close,
  CASE WHEN trades % 5 = 0 THEN -volume ELSE volume END AS volume FROM bars)"""


def _broken(spark, sf):
    b = v.bars(spark, sf)
    return b.select("symbol", "ts", "open", F.when(F.col("trades") % 3 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
                    "low", "close", F.when(F.col("trades") % 5 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))


@query("p09_ohlc_validity", f"""
SELECT symbol, ts, high, volume FROM {BROKEN} b WHERE high >= greatest(open, close, low) AND low <= least(open, close, high)
 AND low > 0 AND volume >= 0""")
def _(spark, sf):
    return _broken(spark, sf).where(fc.valid_ohlc()).select("symbol", "ts", "high", "volume")


@query("p10_p11_clip_and_repair", f"""
SELECT symbol, ts, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, greatest(volume, 0) AS volume FROM {BROKEN} b""")
def _(spark, sf):
    return _broken(spark, sf).withColumns(fc.repaired_ohlc()).select(
        "symbol", "ts", "high", "low", F.greatest("volume", F.lit(0)).alias("volume"))


@query("p12_session_cutoff", """
SELECT CAST(ts AS DATE) AS day, count(*) AS before, CAST(sum(CASE WHEN strftime(ts, '%H:%M') >= '10:30' THEN 1 ELSE 0 END) AS BIGINT) AS after
FROM ticks GROUP BY 1""")
def _(spark, sf):
    return v.ticks(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("before"), F.sum((F.date_format("ts", "HH:mm") >= "10:30").cast("int")).alias("after"))


@query("p13_market_hours", """
SELECT symbol, seq, ts FROM ticks WHERE extract(isodow FROM ts) <= 5
 AND extract(hour FROM ts) * 60 + extract(minute FROM ts) BETWEEN 540 AND 1080""")
def _(spark, sf):
    return v.ticks(spark, sf).where(fc.market_open(F.col("ts"))).select("symbol", "seq", "ts")


@query("p14_p16_size_side_flags", """
SELECT seq, CASE WHEN quantity <= 5 THEN 'small' WHEN quantity <= 20 THEN 'medium' WHEN quantity <= 50 THEN 'large' ELSE 'whale' END AS size_class,
 CASE WHEN side = 'buy' THEN 1 ELSE 0 END AS is_buy, CASE WHEN side = 'sell' THEN 1 ELSE 0 END AS is_sell,
 CASE WHEN side = 'auction' THEN 1 ELSE 0 END AS is_auction,
 CASE WHEN side = 'buy' THEN 'buy' WHEN side = 'sell' THEN 'sell' END AS side FROM ticks""")
def _(spark, sf):
    words = F.when(F.col("side") == "buy", F.when(F.col("seq") % 2 == 0, " COMPRA").otherwise("bid")).when(
        F.col("side") == "sell", "Ask").otherwise("x")
    is_ = lambda s: (F.col("side") == s).cast("int").alias(f"is_{s}")
    return v.ticks(spark, sf).select("seq", fc.size_class(F.col("quantity")).alias("size_class"), is_("buy"), is_("sell"),
                                     is_("auction"), fc.normal_side(words).alias("side"))


TYPE = "CASE WHEN seq % 11 = 0 THEN 'RLP' WHEN seq % 13 = 0 THEN NULL WHEN side = 'buy' THEN 'AggressorBuyer' WHEN side = 'sell' THEN 'AggressorSeller' ELSE 'Auction' END"


@query("p15_trade_type_flags", f"""
SELECT seq, {flag("t = 'AggressorBuyer'")} AS is_buyer, {flag("t = 'AggressorSeller'")} AS is_seller, {flag("t = 'Auction'")} AS is_auction, {flag("t = 'RLP'")} AS is_rlp
FROM (SELECT seq, {TYPE} AS t FROM ticks)""")
def _(spark, sf):
    return v.ticks(spark, sf).withColumns(fc.type_flags(F.expr(TYPE))).select("seq", *fc.TRADE_TYPES)


@query("p17_fixed_bins", """
SELECT seq, CASE WHEN quantity <= 5 THEN 0 WHEN quantity <= 10 THEN 1 WHEN quantity <= 20 THEN 2 WHEN quantity <= 50 THEN 3 ELSE 4 END AS bin FROM ticks""")
def _(spark, sf):
    return v.ticks(spark, sf).select("seq", fc.right_bins(F.col("quantity"), [0, 5, 10, 20, 50, 100]).alias("bin"))


@query("p20_robust_z", f"""
WITH m AS (SELECT symbol AS s, median(price) AS med FROM ticks GROUP BY 1),
d AS (SELECT symbol, seq, price, med, abs(price - med) AS dev FROM ticks JOIN m ON symbol = s),
x AS (SELECT symbol AS s2, median(dev) AS mad FROM d GROUP BY 1)
SELECT symbol, seq, {r("(price - med) / (1.4826::DOUBLE * mad)")} AS z FROM d JOIN x ON symbol = s2""")
def _(spark, sf):
    return cl.robust_z(v.ticks(spark, sf), ["symbol"], "price").select("symbol", "seq", rd("z").alias("z"))


@query("p21_scaling", f"""
WITH w AS (SELECT avg(quantity) AS m, stddev_samp(quantity) AS s FROM ticks)
SELECT symbol, seq, {r("(price - min(price) OVER k) / (max(price) OVER k - min(price) OVER k)")} AS price_scaled,
 {r("(quantity - m) / (s + 1e-8)")} AS quantity_z FROM ticks, w WINDOW k AS (PARTITION BY symbol)""")
def _(spark, sf):
    return cl.scaled(v.ticks(spark, sf), "symbol", "price", "quantity").select(
        "symbol", "seq", rd("price_scaled").alias("price_scaled"), rd("quantity_z").alias("quantity_z"))


@query("p22_quantile_flags", """
WITH q AS (SELECT symbol AS s, quantile_cont(quantity, 0.5) AS a, quantile_cont(quantity, 0.75) AS b, quantile_cont(quantity, 0.9) AS c,
  quantile_cont(quantity, 0.95) AS d FROM ticks GROUP BY 1)
SELECT symbol, seq, CAST(quantity > a AS INT) AS quantity_above_p50, CAST(quantity > b AS INT) AS quantity_above_p75,
 CAST(quantity > c AS INT) AS quantity_above_p90, CAST(quantity > d AS INT) AS quantity_above_p95 FROM ticks JOIN q ON symbol = s""")
def _(spark, sf):
    return cl.quantile_flags(v.ticks(spark, sf), ["symbol"], "quantity", [0.5, 0.75, 0.9, 0.95]).select(
        "symbol", "seq", *[f"quantity_above_p{p}" for p in (50, 75, 90, 95)])


@query("p23_depth_position", f"""
SELECT seq, {r("1.0 / (quantity + 1)")} AS inverse, CAST(quantity <= 5 AS INT) AS top_5, CAST(quantity <= 10 AS INT) AS top_10,
 {r("-ln(quantity + 1) / ln(100)")} AS entropy, {r("quantity / 100.0")} AS position_share, {r("ln(1 + quantity)")} AS quantity_log FROM ticks""")
def _(spark, sf):
    p = F.col("quantity")
    return v.ticks(spark, sf).select(
        "seq", rd(1.0 / (p + 1)).alias("inverse"), (p <= 5).cast("int").alias("top_5"), (p <= 10).cast("int").alias("top_10"),
        rd(-F.log(p + 1) / F.log(F.lit(100.0))).alias("entropy"), rd(p / 100.0).alias("position_share"),
        rd(F.log1p(p)).alias("quantity_log"))


HOLES = """(SELECT seq, CASE WHEN seq % 10 = 0 THEN 'NaN'::DOUBLE WHEN seq % 10 = 1 THEN 'Infinity'::DOUBLE ELSE price END AS a,
 CASE WHEN seq % 3 > 0 THEN NULL ELSE price END AS b, 1.0::DOUBLE AS c, price AS d FROM ticks)"""


def _holes(spark, sf):
    t = v.ticks(spark, sf)
    s = F.col("seq")
    return t.select("seq", F.when(s % 10 == 0, float("nan")).when(s % 10 == 1, float("inf")).otherwise(F.col("price")).alias("a"),
                    F.when(s % 3 == 0, F.col("price")).alias("b"), F.lit(1.0).alias("c"), F.col("price").alias("d"))


@query("p24_finite_and_fill", f"""
SELECT seq, coalesce(CASE WHEN isfinite(a) THEN a END, 50) AS a, coalesce(b, 0) AS b FROM {HOLES} h""")
def _(spark, sf):
    return _holes(spark, sf).select("seq", fc.finite(F.col("a")).alias("a"), "b").na.fill({"a": 50.0, "b": 0.0})


@query("p25_usable_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'1 - count({c}) / count(*)')} AS null_share, {r(f'var_samp({c})', 3)} AS variance, "
    f"CASE WHEN 1 - count({c}) / count(*) <= 0.5 AND coalesce(var_samp({c}), 0) > 0 THEN 1 ELSE 0 END AS keep FROM {HOLES} h"
    for c in ("b", "c", "d")))
def _(spark, sf):
    return cl.usable_columns(_holes(spark, sf), ["b", "c", "d"]).withColumns(
        {"null_share": rd("null_share"), "variance": rd("variance", 3)})


@query("p26_required_columns", """
SELECT seq, coalesce(b, 0) AS ml_b, d AS ml_d, 0.0::DOUBLE AS ml_absent FROM """ + HOLES + " h")
def _(spark, sf):
    h = _holes(spark, sf)
    return h.select("seq", *cl.required(h, ["b", "d", "absent"], "ml_"))


@query("p27_p28_calendar", f"""
WITH a AS (SELECT seq, ts, extract(hour FROM ts) AS h, extract(minute FROM ts) AS m,
  (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP) - 32400000000) AS us FROM ticks)
SELECT seq, h AS hour, m AS minute, extract(isodow FROM ts) - 1 AS weekday, CAST(h = 9 AND m < 30 AS INT) AS is_opening,
 CAST(h >= 9 AND h < 12 AS INT) AS is_morning, CAST(h >= 12 AND h < 14 AS INT) AS is_lunch, CAST(h >= 14 AND h < 16 AS INT) AS is_afternoon,
 CAST(h >= 16 AND h < 17 AS INT) AS is_closing, {r("us / 1e6")} AS seconds_since_open, {r("greatest(us / 6e7, 0)", 3)} AS minutes_since_open,
 {r("least(greatest(us / 6e7, 0), 480) / 480")} AS session_share, {r("sin(2 * pi() * h / 24)")} AS hour_sin,
 {r("cos(2 * pi() * h / 24)")} AS hour_cos, {r("sin(2 * pi() * m / 60)")} AS minute_sin, {r("cos(2 * pi() * m / 60)")} AS minute_cos FROM a""")
def _(spark, sf):
    ts = F.col("ts")
    hs, hc = fc.cyclic(F.hour(ts), 24)
    ms, mc = fc.cyclic(F.minute(ts), 60)
    cal = fc.calendar(ts)
    digits = {"seconds_since_open": 6, "minutes_since_open": 3, "session_share": 6}
    rounded = {k: (rd(c, digits[k]) if k in digits else c) for k, c in cal.items()}
    return v.ticks(spark, sf).select("seq", *[c.alias(k) for k, c in rounded.items()], rd(hs).alias("hour_sin"),
                                     rd(hc).alias("hour_cos"), rd(ms).alias("minute_sin"), rd(mc).alias("minute_cos"))


@query("p29_seasonality", f"""
WITH a AS (SELECT seq, extract(hour FROM ts) * 60 + extract(minute FROM ts) AS m FROM ticks)
SELECT seq, {r("CASE WHEN m BETWEEN 540 AND 630 THEN greatest(0.5, 1 - abs(m - 585.0) / 45) WHEN m BETWEEN 840 AND 930 THEN greatest(0.5, 1 - abs(m - 885.0) / 45) WHEN m BETWEEN 990 AND 1050 THEN greatest(0.5, 1 - abs(m - 1020.0) / 30) ELSE 0.5 END")} AS score FROM a""")
def _(spark, sf):
    return v.ticks(spark, sf).select("seq", rd(fc.seasonality(F.col("ts"))).alias("score"))
