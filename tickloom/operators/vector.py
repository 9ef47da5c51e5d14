"""The fixed, ordered vector of 65 features per bar, with defaults where history is short."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import minute_of_day
from tickloom.operators.aggregates import top_values
from tickloom.operators.bars import time_bars
from tickloom.operators.indicators import rsi_from
from tickloom.operators.windows import clip, div, last_rows, pct_change, rmean, rstd, rsum
from tickloom.session import small_side


# The features in vector order.
FEATURES = [
    "volatility_10", "volatility_20", "volatility_50", "volatility_100", "volatility_ratio_10_20", "volatility_ratio_20_50",
    "volatility_ratio_50_100", "volatility_ratio_100_200", "volatility_gk", "bb_position", "returns_1", "returns_2", "returns_5", "returns_10",
    "returns_20", "returns_50", "returns_100", "log_returns_1", "log_returns_5", "log_returns_20", "order_flow_imbalance_10",
    "order_flow_imbalance_20", "order_flow_imbalance_50", "order_flow_imbalance_100", "cumulative_signed_volume", "signed_volume",
    "volume_weighted_return", "agent_turnover", "volume_ratio_20", "volume_ratio_50", "volume_ratio_100", "volume_zscore_20", "volume_zscore_50",
    "volume_zscore_100", "trade_intensity", "trade_intensity_ratio", "ma_5_20_ratio", "ma_20_50_ratio", "momentum_5_20", "momentum_20_50", "sharpe_5",
    "sharpe_20", "time_normalized", "rsi_14", "top_buyer_0_active", "top_buyer_1_active", "top_buyer_2_active", "top_buyer_3_active",
    "top_buyer_4_active", "top_seller_0_active", "top_seller_1_active", "top_seller_2_active", "top_seller_3_active", "top_seller_4_active",
    "top_buyers_count", "top_sellers_count", "buyer_changed", "seller_changed", "is_buyer_aggressor", "minute", "hour", "day_of_week",
    "is_opening_30min", "is_closing_30min", "is_lunch_hour"]


def names() -> list[str]:
    """Feature names in vector order."""
    return list(FEATURES)


def _ranked(ticks: DataFrame, col: str, side: str) -> DataFrame:
    """The five busiest agents with their rank (five rows)."""
    w = Window.orderBy(F.desc("n"), col)
    return top_values(ticks, col, 5).select(F.col(col).alias(f"_{side}"), (F.row_number().over(w) - 1).alias(f"_{side}_rank"))


def feature_vector(ticks: DataFrame, width: str) -> DataFrame:
    """Bars with all 65 features and the ordered array ``vector``."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = ticks
    for col, side in (("buy_agent", "buyer"), ("sell_agent", "seller")):
        t = t.join(small_side(_ranked(ticks, col, side)), F.col(col) == F.col(f"_{side}"), "left")
    at = F.struct("ts", "seq")
    active = [F.max(F.coalesce((F.col(f"_{s}_rank") == i).cast("int"), F.lit(0))).alias(f"top_{s}_{i}_active") for s in ("buyer", "seller") for i in range(5)]
    who = t.groupBy("symbol", F.window("ts", width).alias("_w")).agg(
        *active, F.count("_buyer").alias("top_buyers_count"), F.count("_seller").alias("top_sellers_count"),
        (F.countDistinct("buy_agent") / F.count(F.lit(1))).alias("agent_turnover"), F.max_by("buy_agent", at).alias("_lb"), F.max_by("sell_agent", at).alias("_ls"),
        F.max_by("side", at).alias("_side"))
    who = who.withColumn("ts", F.col("_w.start")).drop("_w")
    b = time_bars(ticks, width).join(who, ["symbol", "ts"])
    c, v = F.col("close"), F.col("volume")
    hl, co = F.log(F.col("high") / F.col("low")), F.log(c / F.col("open"))
    pc = F.lag(c).over(w)
    b = b.withColumns({"ret": pct_change(c, w), "sv": F.col("buy_volume") - F.col("sell_volume"), "tv": F.col("buy_volume") + F.col("sell_volume"),
                       "gk": 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co, "gain": F.when(c > pc, c - pc).otherwise(0.0), "loss": F.when(c < pc, pc - c).otherwise(0.0)})
    pop = lambda n: F.when(F.count("ret").over(last_rows(w, n - 1)) >= n - 1, F.stddev_pop("ret").over(last_rows(w, n - 1)))
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    b = b.withColumns({f"_v{n}": pop(n) for n in (10, 20, 50, 100, 200)} | {f"_m{n}": rmean(c, w, n) for n in (5, 20, 50)})
    f = {f"volatility_{n}": zero(F.col(f"_v{n}")) for n in (10, 20, 50, 100)}
    f |= {f"volatility_ratio_{x}_{y}": F.coalesce(F.try_divide(f"_v{x}", f"_v{y}"), F.lit(1.0)) for x, y in ((10, 20), (20, 50), (50, 100), (100, 200))}
    f["volatility_gk"] = zero(F.sqrt(clip(rmean(F.col("gk"), w, 20), 0.0)))
    f["bb_position"] = zero(F.try_divide(c - F.col("_m20"), 2 * F.stddev_pop(c).over(last_rows(w, 20))))
    f |= {f"returns_{n}": zero(pct_change(c, w, n)) for n in (1, 2, 5, 10, 20, 50, 100)}
    f |= {f"log_returns_{n}": zero(F.log(c / F.lag(c, n).over(w))) for n in (1, 5, 20)}
    f |= {f"order_flow_imbalance_{n}": zero(div(rsum(F.col("sv"), w, n), rsum(F.col("tv"), w, n))) for n in (10, 20, 50, 100)}
    f["cumulative_signed_volume"] = zero(F.sum("sv").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f["signed_volume"] = zero(F.col("sv"))
    f["volume_weighted_return"] = zero(F.col("ret") * div(v, rmean(v, w, 20)))
    f |= {f"volume_ratio_{n}": zero(div(v, rmean(v, w, n))) for n in (20, 50, 100)}
    f |= {f"volume_zscore_{n}": zero((v - rmean(v, w, n)) / clip(rstd(v, w, n), 0.001)) for n in (20, 50, 100)}
    f["trade_intensity"] = zero(F.col("trades"))
    f["trade_intensity_ratio"] = zero(div(F.col("trades"), rmean(F.col("trades"), w, 20)))
    f["ma_5_20_ratio"], f["ma_20_50_ratio"] = (zero((F.col(x) / F.col(y) - 1) * 100) for x, y in (("_m5", "_m20"), ("_m20", "_m50")))
    f["momentum_5_20"], f["momentum_20_50"] = (zero(F.col(x) / F.col(y) - 1) for x, y in (("_m5", "_m20"), ("_m20", "_m50")))
    f["sharpe_5"] = zero(pct_change(c, w, 5) / clip(F.col("_v10"), 0.0001))
    f["sharpe_20"] = zero(pct_change(c, w, 20) / clip(F.col("_v50"), 0.0001))
    m, h = minute_of_day(F.col("ts")), F.hour("ts")
    f["time_normalized"] = F.least(F.greatest((m - 540) / 480.0, F.lit(0.0)), F.lit(1.0))
    f["rsi_14"] = F.coalesce(rsi_from(rmean(F.col("gain"), w, 14), rmean(F.col("loss"), w, 14)), F.lit(50.0))
    changed = lambda x: F.coalesce((F.col(x) != F.lag(x).over(w)).cast("double"), F.lit(0.0))
    f |= {"buyer_changed": changed("_lb"), "seller_changed": changed("_ls"), "is_buyer_aggressor": (F.col("_side") == "buy").cast("double"),
          "minute": F.minute("ts").cast("double"), "hour": h.cast("double"), "day_of_week": F.weekday("ts").cast("double"),
          "is_opening_30min": m.between(540, 569).cast("double"), "is_closing_30min": m.between(1050, 1080).cast("double"), "is_lunch_hour": h.between(12, 13).cast("double")}
    made = {*f, "top_buyers_count", "top_sellers_count", "agent_turnover", *(f"top_{s}_{i}_active" for s in ("buyer", "seller") for i in range(5))}
    assert made == set(FEATURES), made ^ set(FEATURES)
    ready = names()
    out = b.withColumns(f).select("symbol", "ts", *[F.col(n).cast("double").alias(n) for n in ready])
    return out.withColumn("vector", F.array(*ready))
