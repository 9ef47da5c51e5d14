"""Adapter views: the driver's tables seen as ticks, bars, quotes, books, trades and predictions.

Each view exists once in Spark and once in DuckDB SQL, with the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as bar_ops
from tickloom.session import shared_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One driver table; TIMESTAMP_NTZ columns become TIMESTAMP at the scan."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    shared_dir(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    ntz = {f: F.col(f).cast("timestamp") for f, t in df.dtypes if t == "timestamp_ntz"}
    return df.withColumns(ntz) if ntz else df


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
        F.round(F.lit(100.0) + F.col("value"), 2).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, "buy").when(F.col("event_id") % 3 == 1, "sell")
        .otherwise("auction").alias("side"),
        F.col("user_id").alias("buy_agent"),
        ((F.col("user_id") * 7 + 3) % 97).alias("sell_agent"))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bar_ops.time_bars(ticks(spark, sf), "1 hour")


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    return e.select(
        (F.col("user_id") % 10).alias("k"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "bid").otherwise("ask").alias("side"),
        F.round(F.lit(100.0) + F.col("value"), 2).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("quantity"))


def trades_k(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    return e.select(
        (F.col("user_id") % 10).alias("k"), "ts", F.col("event_id").alias("seq"),
        F.round(F.lit(100.0) + F.col("value"), 2).alias("price"),
        (F.get_json_object("props", "$.k").cast("long") + 1).alias("quantity"))


def book_l2(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots with five levels a side, as arrays (level 1 first)."""
    e = table(spark, sf, "embeddings")
    vol = lambda lo: F.transform(
        F.slice("embedding", lo, 5), lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double"))
    return e.select(
        F.col("vec_id").alias("seq"), F.col("label").cast("long").alias("symbol"),
        F.array(*[F.lit(100.0 - 0.5 * i) for i in range(1, 6)]).alias("bid_prices"),
        vol(1).alias("bid_volumes"),
        F.array(*[F.lit(100.0 + 0.5 * i) for i in range(1, 6)]).alias("ask_prices"),
        vol(6).alias("ask_volumes"))


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"),
        F.lit(1).cast("long").alias("quantity"), F.lit("auction").alias("side"))
    return bar_ops.time_bars(o, "1 day")


def dirty_ticks(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumn(
        "price", F.when(F.col("seq") % 53 == 0, None).when(F.col("seq") % 71 == 0, -1.0)
        .otherwise(F.col("price"))).withColumn("copy", F.lit(0).cast("long"))
    again = t.where(F.col("seq") % 37 == 0).withColumn("copy", F.lit(1).cast("long"))
    return t.unionByName(again)


def source_a(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where((F.col("seq") % 2 == 0) | (F.col("seq") % 5 == 0))


def source_b(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).where((F.col("seq") % 2 == 1) | (F.col("seq") % 5 == 0)).withColumn(
        "price", F.round(F.col("price") * 1.0005, 6))


def closed_trades(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("leg"),
        F.when(F.col("l_orderkey") % 2 == 0, "long").otherwise("short").alias("side"),
        F.col("o_orderpriority").alias("regime"),
        F.least("o_orderdate", "l_shipdate").alias("entry_ts"),
        F.greatest("o_orderdate", "l_shipdate").alias("exit_ts"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * 1500, 4).alias("pnl"))


def model_preds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("model_a"),
        F.col("toxic").cast("long").alias("model_b"), (F.col("doc_id") % 2).alias("actual"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class predictions keyed by symbol and time, derived from the ticks."""
    t = ticks(spark, sf)
    return t.select(
        "symbol", "ts", "seq", (F.col("quantity") % 3).alias("predicted"),
        F.when(F.col("seq") % 4 == 0, F.col("quantity") % 3).otherwise(F.col("buy_agent") % 3).alias("actual"),
        (F.lit(0.3) + F.col("quantity") / 203.0).alias("confidence"))


def agent_signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("agent"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, "buy").when(F.col("event_id") % 3 == 1, "sell")
        .otherwise("hold").alias("action"),
        F.least(F.col("value") / 300.0, F.lit(1.0)).alias("confidence"))


SQL: dict[str, str] = {
    "ticks": """
        SELECT event_type AS symbol, ts, event_id AS seq, round(100.0::DOUBLE + value, 2) AS price,
               CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS quantity,
               CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'auction' END AS side,
               user_id AS buy_agent, (user_id * 7 + 3) % 97 AS sell_agent
        FROM events""",
    "bars": """
        SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, seq_ts) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, seq_ts) AS close, CAST(sum(quantity) AS BIGINT) AS volume,
               count(*) AS trades,
               CAST(sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume,
               CAST(sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume,
               CAST(sum(CASE WHEN side = 'buy' THEN 1 ELSE 0 END) AS BIGINT) AS buy_trades,
               CAST(sum(CASE WHEN side = 'sell' THEN 1 ELSE 0 END) AS BIGINT) AS sell_trades,
               sum(price * quantity) AS turnover
        FROM (SELECT *, (ts, seq) AS seq_ts FROM ticks) GROUP BY 1, 2""",
    "barx": """
        SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, close - lag(close) OVER w AS delta,
               CASE WHEN close > lag(close) OVER w THEN close - lag(close) OVER w ELSE 0.0::DOUBLE END AS gain,
               CASE WHEN close < lag(close) OVER w THEN lag(close) OVER w - close ELSE 0.0::DOUBLE END AS loss,
               close / lag(close) OVER w - 1 AS ret,
               greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
               high - lag(high) OVER w AS hd, lag(low) OVER w - low AS ld
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "quotes": """
        SELECT user_id % 10 AS k, ts, event_id AS seq,
               CASE WHEN event_type = 'view' THEN 'bid' ELSE 'ask' END AS side,
               round(100.0::DOUBLE + value, 2) AS price,
               CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS quantity
        FROM events WHERE event_type IN ('view', 'click')""",
    "trades_k": """
        SELECT user_id % 10 AS k, ts, event_id AS seq, round(100.0::DOUBLE + value, 2) AS price,
               CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS quantity
        FROM events WHERE event_type = 'purchase'""",
    "book_l2": """
        SELECT vec_id AS seq, CAST(label AS BIGINT) AS symbol,
               [99.5::DOUBLE, 99.0, 98.5, 98.0, 97.5] AS bid_prices,
               [floor(abs(CAST(x AS DOUBLE)) * 1000) FOR x IN embedding[1:5]] AS bid_volumes,
               [100.5::DOUBLE, 101.0, 101.5, 102.0, 102.5] AS ask_prices,
               [floor(abs(CAST(x AS DOUBLE)) * 1000) FOR x IN embedding[6:10]] AS ask_volumes
        FROM embeddings""",
    "day_bars": """
        SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
               arg_min(o_totalprice, k) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
               arg_max(o_totalprice, k) AS close, count(*) AS volume, count(*) AS trades,
               sum(o_totalprice) AS turnover
        FROM (SELECT *, (o_orderdate, o_orderkey) AS k FROM orders) GROUP BY 1, 2""",
    "dirty_ticks": """
        SELECT * REPLACE (CASE WHEN seq % 53 = 0 THEN NULL WHEN seq % 71 = 0 THEN -1.0::DOUBLE ELSE price END AS price),
               c AS copy
        FROM ticks, (SELECT unnest([0, 1])::BIGINT AS c) WHERE c = 0 OR seq % 37 = 0""",
    "source_a": "SELECT * FROM ticks WHERE seq % 2 = 0 OR seq % 5 = 0",
    "source_b": """
        SELECT * REPLACE (round(price * 1.0005::DOUBLE, 6) AS price) FROM ticks WHERE seq % 2 = 1 OR seq % 5 = 0""",
    "closed_trades": """
        SELECT l_orderkey AS trade_id, l_linenumber AS leg,
               CASE WHEN l_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_orderpriority AS regime,
               least(o_orderdate, l_shipdate) AS entry_ts, greatest(o_orderdate, l_shipdate) AS exit_ts,
               l_quantity AS quantity,
               round(l_extendedprice * (1 - l_discount) - l_quantity * 1500, 4) AS pnl
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "model_preds": """
        SELECT doc_id AS id, CAST(quality AS BIGINT) AS model_a, CAST(toxic AS BIGINT) AS model_b,
               doc_id % 2 AS actual FROM labels""",
    "predictions": """
        SELECT symbol, ts, seq, quantity % 3 AS predicted,
               CASE WHEN seq % 4 = 0 THEN quantity % 3 ELSE buy_agent % 3 END AS actual,
               0.3::DOUBLE + quantity / 203.0::DOUBLE AS confidence FROM ticks""",
    "agent_signals": """
        SELECT event_type AS agent, ts, event_id AS seq,
               CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'hold' END AS action,
               least(value / 300.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM events""",
}
