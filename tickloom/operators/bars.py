"""Time bars: ticks to OHLCV with buy/sell microstructure, and bars to larger bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_bars(ticks: DataFrame, width: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of ``width``; first/last price by (ts, seq).

    One hash aggregation with map-side partials, so a hot symbol costs a few rows per task.
    """
    at = F.struct("ts", "seq")
    q = F.col("quantity")
    is_buy, is_sell = F.col("side") == "buy", F.col("side") == "sell"
    agg = ticks.groupBy(*keys, F.window("ts", width).alias("_w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(is_buy, q).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(is_sell, q).otherwise(0)).alias("sell_volume"),
        F.sum(F.when(is_buy, 1).otherwise(0)).alias("buy_trades"),
        F.sum(F.when(is_sell, 1).otherwise(0)).alias("sell_trades"),
        F.sum(F.col("price") * q).alias("turnover"))
    return agg.select(*keys, F.col("_w.start").alias("ts"), *agg.columns[len(keys) + 1:])


def resample(bars: DataFrame, width: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars to larger bars; empty bars do not appear."""
    agg = bars.groupBy(*keys, F.window("ts", width).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades").alias("trades"))
    return agg.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close",
                      "volume", "trades")


def imbalance(buy: Column, sell: Column) -> Column:
    return F.coalesce(F.try_divide(buy - sell, buy + sell), F.lit(0.0))


def microstructure(bars: DataFrame) -> DataFrame:
    return bars.select(
        "symbol", "ts", "buy_volume", "sell_volume", "buy_trades", "sell_trades",
        imbalance(F.col("buy_volume"), F.col("sell_volume")).alias("imbalance"),
        (F.col("volume") / F.col("trades")).alias("avg_trade_size"),
        F.col("trades").alias("trade_count"))
