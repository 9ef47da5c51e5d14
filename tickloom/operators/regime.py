"""Market regimes from trend indicators, volatility and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.indicators import adx, ema_set
from tickloom.operators.scan import smooth
from tickloom.operators.windows import div, last_rows, pct_change, rmean, rmedian, rstd

# Regime, confidence, probability, direction and magnitude limits, risk/reward.
REGIME_LIMITS = [
    ("trend_up", 0.60, 0.60, 0.70, 0.003, 2.0),
    ("trend_down", 0.60, 0.60, 0.70, 0.003, 2.0),
    ("range", 0.60, 0.55, 0.50, 0.0015, 1.5),
    ("undefined", 0.80, 0.80, 0.80, 0.005, 1.0),
]


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGIME_LIMITS, "regime string, min_confidence double, min_probability double, min_direction double, "
                       "min_magnitude double, risk_reward double")


def trend_inputs(bars: DataFrame) -> DataFrame:
    """Bars with EMA 9/20/50 (rounded, so equal means compare equal) and ADX."""
    e = ema_set(bars, [9, 20, 50]).select("symbol", "ts", *[F.round(f"ema_{n}", 9).alias(f"ema_{n}") for n in (9, 20, 50)])
    a = adx(bars).select("symbol", "ts", F.round("adx_sma", 9).alias("adx"))
    return bars.join(e, ["symbol", "ts"]).join(a, ["symbol", "ts"])


def classify(t: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Regime, confidence and strength from ADX and the order of the means."""
    up = (F.col("ema_9") > F.col("ema_20")) & (F.col("ema_20") > F.col("ema_50"))
    down = (F.col("ema_9") < F.col("ema_20")) & (F.col("ema_20") < F.col("ema_50"))
    x = F.coalesce("adx", F.lit(20.0))
    regime = F.when((x > threshold) & up, "trend_up").when((x > threshold) & down, "trend_down").when(
        x < threshold, "range").otherwise("undefined")
    t = t.withColumn("regime", regime)
    trending = F.col("regime").startswith("trend")
    return t.withColumns({
        "confidence": F.when(trending, F.least(F.lit(0.8), 0.5 + (x - 25) / 75)).when(F.col("regime") == "range", 0.6).otherwise(0.3),
        "strength": F.when(trending, F.when(x > 35, "strong").otherwise("moderate")).when(F.col("regime") == "range", "weak").otherwise("mixed"),
        "label": F.when(x <= threshold, "range").when(up, "trend_up").when(down, "trend_down").otherwise("undefined")})


def with_limits(t: DataFrame) -> DataFrame:
    """Regime limits on every row; the lookup has four rows, so its broadcast is bounded."""
    return t.join(F.broadcast(limits(t.sparkSession)), "regime", "left")


def trend_flags(bars: DataFrame) -> DataFrame:
    """Up/down/ranging flags, and the volatility class of ATR against its mean."""
    w = Window.partitionBy("symbol").orderBy("ts")
    pc = F.lag("close").over(w)
    b = bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    b = smooth(b.select("symbol", "ts", "close", "tr"), ["symbol"], "ts",
               [("e20", "close", "ema", 20), ("e50", "close", "ema", 50), ("atr", "tr", "ema", 14)])
    e20, e50, c = F.round("e20", 9), F.round("e50", 9), F.col("close")
    b = b.withColumns({"uptrend": ((e20 > e50) & (c > e20)).cast("int"), "downtrend": ((e20 < e50) & (c < e20)).cast("int"),
                       "ratio": F.coalesce(div(F.col("atr"), rmean(F.col("atr"), w, 50)), F.lit(1.0))})
    return b.withColumns({"ranging": 1 - F.col("uptrend") - F.col("downtrend"),
                          "volatility_class": F.when(F.col("ratio") <= 0.8, 0).when(F.col("ratio") <= 1.2, 1).otherwise(2)})


def distribution(t: DataFrame, start: int, step: int = 1) -> DataFrame:
    """Regime shares over every ``step``-th bar from bar ``start`` on, and the dominant one."""
    w = Window.partitionBy("symbol").orderBy("ts")
    s = t.withColumn("_i", F.row_number().over(w) - 1).where((F.col("_i") >= start) & ((F.col("_i") - start) % step == 0))
    per = s.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("symbol").agg(F.sum("n").alias("_all"), F.max_by("regime", F.struct("n", "regime")).alias("_top"))
    return per.join(total, "symbol").select("symbol", "regime", "n", (F.col("n") / F.col("_all")).alias("share"),
                                            (F.col("regime") == F.col("_top")).cast("int").alias("dominant"))


def from_probabilities(sell: Column, hold: Column, buy: Column, threshold: float) -> tuple[Column, Column]:
    top = F.greatest(sell, hold, buy)
    regime = F.when((buy == top) & (buy > threshold), "trend_up").when((sell == top) & (sell > threshold), "trend_down").when(
        hold > 0.5, "range").otherwise("undefined")
    return regime, F.when(regime == "range", hold).otherwise(top)


def strength_flags(bars: DataFrame) -> DataFrame:
    """High/low volatility against its rolling median, and strong moves of twenty bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("_ret", pct_change(F.col("close"), w)).withColumn("vol", rstd(F.col("_ret"), w, 30))
    med = rmedian(F.col("vol"), w, 100)
    mom = pct_change(F.col("close"), w, 20)
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return b.withColumns({"high_vol": flag(F.col("vol") > med * 1.1), "low_vol": flag(F.col("vol") < med * 0.9),
                          "strong_up": flag(mom > 0.01), "strong_down": flag(mom < -0.01)})


def confirm_trend(t: DataFrame) -> DataFrame:
    """Vote of the mean order and of the 20-bar slope."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = t.withColumn("_i", F.row_number().over(w))
    f = last_rows(w, 20)
    order = F.when((F.col("ema_9") > F.col("ema_20")) & (F.col("ema_20") > F.col("ema_50")), 1).when(
        (F.col("ema_9") < F.col("ema_20")) & (F.col("ema_20") < F.col("ema_50")), -1)
    slope = F.when(F.col("_i") >= 20, F.when(F.regr_slope("close", "_i").over(f) > 0, 1).otherwise(-1))
    votes = F.array_compact(F.array(order, slope))
    mean = F.when(F.size(votes) > 0, F.aggregate(votes, F.lit(0), lambda a, x: a + x) / F.size(votes)).otherwise(0.0)
    return t.withColumns({"direction": F.signum(mean), "trend_strength": F.abs(mean)})
