"""Signals, votes, consensus, sizing and alerts as column expressions over joined tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import lay_out
from tickloom.operators.windows import div, last_rows, pct_change, rmean
from tickloom.session import pin, small_side

# Weights and limits of the scoring rules.
GATE = {"direction": 0.3, "magnitude": 0.0001, "confidence": 0.6}
QUALITY_WEIGHTS = {"confidence": 0.25, "alignment": 0.30, "history": 0.20, "market": 0.15, "clarity": 0.10}
TAPE_WEIGHTS = {"speed": 0.3, "pattern": 0.4, "momentum": 0.3}
LIQUIDITY_WEIGHTS = {"depth": 0.4, "hidden": 0.3, "consumption": 0.3}
MODEL_WEIGHT, AGENT_WEIGHT = 0.4, 0.6
STOP_WEIGHTS = {"trending": (0.4, 0.35, 0.25), "ranging": (0.3, 0.2, 0.5), "high_volatility": (0.4, 0.5, 0.1)}
REGIME_SIZE = {"trend_up": 1.15, "trend_down": 1.15, "range": 0.95, "undefined": 0.8, "volatile": 0.7}


def lookup(c: Column, table: dict, default) -> Column:
    out = reduce(lambda acc, kv: F.when(c == kv[0], kv[1]) if acc is None else acc.when(c == kv[0], kv[1]), table.items(), None)
    return out.otherwise(default)


def steps(x: Column, cuts: list[tuple[float, float]], default: float) -> Column:
    """First value whose bound x exceeds."""
    out = None
    for bound, value in cuts:
        out = F.when(x > bound, value) if out is None else out.when(x > bound, value)
    return out.otherwise(default)


def inputs(bars: DataFrame) -> DataFrame:
    """Direction, magnitude, confidence, regime and ATR of each bar, the inputs of the rules below."""
    w = Window.partitionBy("symbol").orderBy("ts")
    pc, c = F.lag("close").over(w), F.col("close")
    b, s = F.col("buy_volume"), F.col("sell_volume")
    d = F.coalesce(div(b - s, b + s), F.lit(0.0))
    t = bars.withColumns({"direction": d, "ret": c / pc - 1, "rn": F.row_number().over(w), "tr": F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)), "sma": rmean(c, w, 20)})
    return t.withColumns({
        "magnitude": F.abs("ret"), "confidence": 0.5 + 0.5 * F.abs("direction"), "atr": rmean(F.col("tr"), w, 14),
        "regime": F.when(F.col("sma").isNull(), "undefined").when(c > F.col("sma") * 1.05, "trend_up").when(
            c < F.col("sma") * 0.95, "trend_down").otherwise("range")})


def gated_signal(t: DataFrame, min_stop: float, risk_reward: float, point: float) -> DataFrame:
    """Action behind the three gates, with stop and target by ATR and regime on the price grid."""
    d, m, c = F.col("direction"), F.col("magnitude"), F.col("confidence")
    reason = F.when(m.isNull() | F.col("atr").isNull(), "no_market_data").when(F.abs(d) < GATE["direction"], "direction").when(
        m < GATE["magnitude"], "magnitude").when(c < GATE["confidence"], "confidence")
    t = t.withColumn("blocked", reason).withColumn("action", F.when(F.col("blocked").isNotNull(), "none").when(d > 0, "buy").otherwise("sell"))
    stop = F.greatest(F.col("atr") * 1.5, F.lit(min_stop)) * F.when(F.col("regime").startswith("trend"), 0.8).when(F.col("regime") == "range", 1.2).otherwise(1.0)
    take = F.greatest(F.greatest(m * F.col("close"), stop), stop * risk_reward)
    side = F.when(F.col("action") == "buy", 1).when(F.col("action") == "sell", -1)
    grid = lambda x: F.bround(x / point, 0) * point + 0.0
    t = t.withColumns({"stop": grid(F.col("close") - side * stop), "target": grid(F.col("close") + side * take)})
    return t.withColumn("risk_reward", F.try_divide(F.abs(F.col("target") - F.col("close")), F.abs(F.col("close") - F.col("stop"))))


def hybrid(t: DataFrame) -> DataFrame:
    """Tick and book signals blended by regime, with boost, floor and conflict rule."""
    ts, tc, bs, bc, reg = (F.col(x) for x in ("tick_signal", "tick_confidence", "book_signal", "book_confidence", "regime"))
    trend = reg.startswith("trend")
    wt, wb = F.when(trend, 0.6).when(reg == "range", 0.3).otherwise(0.5), F.when(trend, 0.4).when(reg == "range", 0.7).otherwise(0.5)
    boost = F.when(trend, F.when((ts == bs) & (ts != 0), 1.2).otherwise(1.0)).when(reg == "range", F.when(bc > 0.7, 1.1).otherwise(1.0)).otherwise(0.8)
    value, conf = F.round(ts * tc * wt + bs * bc * wb, 9), F.round((tc * wt + bc * wb) * boost, 9)
    clash = (ts * bs < 0) & (tc > 0.7) & (bc > 0.7)
    return t.withColumns({"signal": F.when(clash | (conf < 0.5) | (F.abs(value) < 0.3), 0).when(value > 0, 1).otherwise(-1),
                          "blend": F.least(F.when(clash, conf * 0.5).otherwise(conf), F.lit(1.0))})


def position_size(t: DataFrame, balance: float, cap: float) -> DataFrame:
    reg = F.col("regime")
    base = F.least(F.col("blend") * 0.25, F.lit(0.1)) * F.when(reg.startswith("trend"), F.when(F.col("confidence") > 0.7, 1.2).otherwise(1.0)).when(
        reg == "range", 0.8).otherwise(0.5)
    return t.withColumn("contracts", F.when(F.col("signal") == 0, 0.0).otherwise(F.least(balance * base / F.col("close"), F.lit(cap))))


def vote(votes: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Majority action of (action, confidence) votes, nulls abstaining; on a tie the surest vote.

    Confidence is the mean of the winning side.
    """
    arr = F.array_compact(F.array(*[F.when(a.isin("buy", "sell"), F.struct(c.cast("double").alias("c"), a.alias("a"))) for a, c in votes]))
    side = lambda s: F.filter(arr, lambda x: x.a == s)
    buy, sell = side("buy"), side("sell")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.c) / F.size(xs)
    top = F.array_max(arr)
    action = F.when(F.size(arr) == 0, "hold").when(F.size(buy) > F.size(sell), "buy").when(F.size(sell) > F.size(buy), "sell").otherwise(top.a)
    conf = F.when(F.size(arr) == 0, 0.0).when(F.size(buy) > F.size(sell), mean(buy)).when(F.size(sell) > F.size(buy), mean(sell)).otherwise(top.c)
    return action, conf


def flow_vote(t: DataFrame, ofi_limit: float, delta_limit: float) -> DataFrame:
    """Votes of order-flow imbalance, delta divergence, extreme delta, absorption and sweep."""
    w = Window.partitionBy("symbol").orderBy("ts")
    t = t.withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
    t = t.withColumns({"ofi_slow": F.round(rmean(F.col("direction"), w, 5, 1), 9), "velocity": F.col("direction") - F.lag("direction").over(w),
                       "cvd": F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)), "trend": rmean(F.col("delta"), w, 10),
                       "change": F.col("close") / F.lag("close", 9).over(w) - 1, "busy": div(F.col("volume"), rmean(F.col("volume"), w, 20)),
                       "lowest": F.min("direction").over(last_rows(w, 3)), "highest": F.max("direction").over(last_rows(w, 3))})
    d, slow = F.col("direction"), F.col("ofi_slow")
    ofi = F.when((d > ofi_limit) & (slow > ofi_limit) & (F.col("velocity") > 0), "buy").when(
        (d < -ofi_limit) & (slow < -ofi_limit) & (F.col("velocity") < 0), "sell")
    diverge = F.when((F.col("change") < 0) & (F.col("trend") > 0), "buy").when((F.col("change") > 0) & (F.col("trend") < 0), "sell")
    extreme = F.abs("cvd") > delta_limit
    delta = F.coalesce(diverge, F.when(extreme, F.when(F.col("cvd") > 0, "buy").otherwise("sell")))
    absorbed = (F.col("busy") >= 1.5) & (F.abs("ret") < 0.2)
    absorption = F.when(absorbed & (d > 0.2), "sell").when(absorbed & (d < -0.2), "buy")
    sweep = F.when((F.col("rn") >= 3) & (F.col("lowest") > 0.3), "buy").when((F.col("rn") >= 3) & (F.col("highest") < -0.3), "sell")
    action, conf = vote([(ofi, F.least(F.abs(d) * 2, F.lit(1.0))), (delta, F.when(extreme, 0.7).otherwise(0.6)), (absorption, F.lit(0.7)), (sweep, F.lit(0.8))])
    return t.withColumns({"action": action, "vote_confidence": conf})


def liquidity_signal(book: DataFrame) -> DataFrame:
    """Signal from depth; needs liquidity_score, depth_imbalance, hidden_bid, hidden_ask, consumption and iceberg."""
    im, sc, use = F.col("depth_imbalance"), F.col("liquidity_score"), F.col("consumption")
    action = F.when(sc < 0.3, "hold").when(im > 0.3, "buy").when(im < -0.3, "sell").otherwise("hold")
    hidden = F.when(im > 0, F.col("hidden_bid") > 0).otherwise(F.col("hidden_ask") > 0)
    base = F.least((0.5 + F.abs(im) * 0.3) * F.when(hidden, 1.2).otherwise(1.0), F.lit(0.9))
    conf = F.when(action == "hold", 0.0).otherwise(base) * F.when(use > 0.7, 1.1).otherwise(1.0) * F.when(F.col("iceberg") > 0.5, 0.8).otherwise(1.0)
    w = LIQUIDITY_WEIGHTS
    mixed = F.least(conf * w["depth"] + sc * w["hidden"] + (1 - use) * w["consumption"], F.lit(1.0))
    return book.withColumns({"action": action, "signal_confidence": F.when(sc < 0.3, 0.0).otherwise(mixed)})


def tape_signal(t: DataFrame) -> DataFrame:
    """Weighted best action of the speed, pattern and momentum components.

    Needs speed_ratio, sweep ('buy'/'sell'/other), price_momentum and direction.
    """
    sr, pm, d = F.col("speed_ratio"), F.col("price_momentum"), F.col("direction")
    speed_c = F.when(sr > 2, F.greatest(F.least((sr - 1) * 0.5, F.lit(1.0)) * 0.8, F.lit(0.5))).when(sr > 1.5, 0.5).otherwise(0.0)
    speed_a = F.when(sr > 2, "buy").otherwise("hold")
    pat = F.col("sweep").isin("buy", "sell")
    up, down = (pm > 0.5) & (d > 0.3), (pm < -0.5) & (d < -0.3)
    mom_c = F.when(up | down, F.least((F.abs(pm) + F.abs(d)) / 2, F.lit(1.0))).otherwise(0.0)
    parts = [("speed", speed_a, speed_c), ("pattern", F.when(pat, F.col("sweep")).otherwise("hold"), F.when(pat, 0.8).otherwise(0.0)),
             ("momentum", F.when(up, "buy").when(down, "sell").otherwise("hold"), mom_c)]
    score = lambda a: sum((F.when((act == a) & (c > 0), c * TAPE_WEIGHTS[n]).otherwise(0.0) for n, act, c in parts), F.lit(0.0))
    total = sum((F.when(c > 0, TAPE_WEIGHTS[n]).otherwise(0.0) for n, _, c in parts), F.lit(0.0))
    t = t.withColumns({"_b": F.round(score("buy"), 9), "_s": F.round(score("sell"), 9), "_h": F.round(score("hold"), 9), "_t": total})
    top = F.greatest("_b", "_s", "_h")
    action = F.when(top == 0, "hold").when(F.col("_b") == top, "buy").when(F.col("_s") == top, "sell").otherwise("hold")
    return t.withColumns({"action": action, "tape_confidence": F.coalesce(F.try_divide(top, F.col("_t")), F.lit(0.0))})


def agent_scores(t: DataFrame) -> DataFrame:
    """Linear scores of the flow, liquidity, tape and footprint agents, with level and confidence.

    Needs ofi_5, ofi_10, vol_5, vol_10 (signed volume shares), book_imbalance, volume_ratio, spread_z,
    large_ratio, velocity, vwap_distance, skew, concentration, vol_ratio, ret_5.
    """
    c = F.col
    flow = (c("ofi_5") * 0.6 + c("ofi_10") * 0.4) * 0.4 + (c("vol_5") * 0.6 + c("vol_10") * 0.4) * 0.3 + c("book_imbalance") * 0.3
    z = c("spread_z")
    liq = (F.when(c("volume_ratio") > 1.2, 0.3).when(c("volume_ratio") < 0.8, -0.3).otherwise(0.0)
           + F.when(z < -1, 0.2 * F.abs(z)).when(z > 1, -0.1 * z).otherwise(0.0) + c("book_imbalance") * 0.3)
    fs = c("ofi_5") * 0.6 + c("ofi_10") * 0.4
    vd = c("vwap_distance")
    tape = (fs * 0.3 + c("vol_5") * 0.25 + F.when(c("large_ratio") > 0.3, 0.2 * F.signum(fs)).otherwise(0.0)
            + F.when(c("velocity") > 1.5, 0.15 * F.signum(fs)).otherwise(0.0) + F.when(vd > 0.002, 0.1).when(vd < -0.002, -0.1).otherwise(0.0)
            + c("book_imbalance") * 0.2)
    foot = (F.when((c("skew") > 0.2) & (c("vol_5") > 0.3), 0.4).when((c("skew") < -0.2) & (c("vol_5") < -0.3), -0.4).otherwise(0.0)
            + F.when(c("concentration") > 0.6, F.signum(vd) * 0.3).otherwise(0.0) + F.when(c("vol_ratio") > 1.5, F.signum(c("ret_5")) * 0.2).otherwise(0.0))
    level = lambda s, strong, weak: F.when(s > strong, 2).when(s > weak, 1).when(s < -strong, -2).when(s < -weak, -1).otherwise(0)
    named = {"flow": (flow, 0.5, 0.3, 1.5, 1.0), "liquidity": (liq, 9.0, 0.3, 1.0, 0.9), "tape": (tape, 0.6, 0.35, 1.2, 0.95), "footprint": (foot, 0.5, 0.3, 1.3, 0.9)}
    t = t.withColumns({f"{n}_score": F.round(s, 9) for n, (s, *_) in named.items()})
    return t.withColumns({f"{n}_level": level(F.col(f"{n}_score"), st, wk) for n, (_, st, wk, _, _) in named.items()}
                         | {f"{n}_confidence": F.least(F.abs(f"{n}_score") * k, F.lit(top)) for n, (_, _, _, k, top) in named.items()})


def consensus(signals: DataFrame, width: str) -> DataFrame:
    """Direction, strength and confidence of the agent signals in each time bucket."""
    side = lambda s: F.sum(F.when(F.col("action") == s, F.col("confidence")).otherwise(0.0))
    g = signals.groupBy(F.window("ts", width).alias("w")).agg(
        side("buy").alias("buy_strength"), side("sell").alias("sell_strength"), F.count(F.lit(1)).alias("agents"))
    b, s = F.round("buy_strength", 9), F.round("sell_strength", 9)
    total, top = b + s, F.greatest(b, s)
    return g.select(F.col("w.start").alias("ts"), "agents", "buy_strength", "sell_strength",
                    F.when(total == 0, "neutral").when(b > s, "bullish").otherwise("bearish").alias("direction"),
                    F.coalesce(F.try_divide(top, total), F.lit(0.0)).alias("strength"),
                    F.coalesce(F.try_divide(top, total) * F.try_divide(F.abs(b - s), total), F.lit(0.0)).alias("confidence"))


def success_table(signals: DataFrame) -> DataFrame:
    """Successes and total per agent (one row each)."""
    return signals.groupBy("agent").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("success").cast("int")).alias("wins"))


def quality_score(signals: DataFrame, flow: DataFrame, width: str) -> DataFrame:
    """Weighted quality of each signal from confidence, flow alignment, history, market hour and clarity."""
    s = signals.withColumn("bucket", F.window("ts", width).start)
    f = flow.select(F.col("ts").alias("bucket"), F.col("direction").alias("flow"), "strength")
    s = s.join(f, "bucket", "left").join(small_side(success_table(signals)), "agent", "left")
    st, a = F.coalesce("strength", F.lit(0.0)), F.col("action")
    agree = ((a == "buy") & (F.col("flow") == "bullish")) | ((a == "sell") & (F.col("flow") == "bearish"))
    against = ((a == "buy") & (F.col("flow") == "bearish")) | ((a == "sell") & (F.col("flow") == "bullish"))
    align = F.when(st == 0, 0.5).when(agree, F.least(st * 1.2, F.lit(1.0))).when(against, F.greatest(0.2 - st * 0.5, F.lit(0.0))).otherwise(0.5)
    history = F.coalesce(F.col("wins") / F.col("total") * F.least(F.col("total") / 100.0, F.lit(1.0)), F.lit(0.5))
    market = F.least(0.5 + F.when(F.hour("ts").between(10, 16), 0.2).otherwise(0.0), F.lit(1.0))
    clarity = F.when(a.isNull(), 0.0).otherwise(0.5)
    w = QUALITY_WEIGHTS
    return s.withColumn("quality", F.least(F.col("confidence") * w["confidence"] + align * w["alignment"] + history * w["history"]
                                           + market * w["market"] + clarity * w["clarity"], F.lit(1.0)))


def decide(t: DataFrame, votes: list[tuple[str, str]], features: list[str], model: str = "probability",
           model_weight: float = MODEL_WEIGHT, agent_weight: float = AGENT_WEIGHT) -> DataFrame:
    """Model and agents combined to a seven-level action with confidence; ``votes`` are (signal, confidence) columns."""
    ml = (F.col(model) - 0.5) * 2
    weight = sum((F.col(c) for _, c in votes), F.lit(0.0))
    agent = F.coalesce(F.try_divide(sum((F.col(s) * F.col(c) for s, c in votes), F.lit(0.0)), weight), F.lit(0.0))
    k = len(votes)
    mean = sum((F.col(s) for s, _ in votes), F.lit(0.0)) / k
    std = F.sqrt(sum(((F.col(s) - mean) * (F.col(s) - mean) for s, _ in votes), F.lit(0.0)) / k)
    good = sum(((F.col(f).isNotNull() & (F.col(f) != 0)).cast("int") for f in features), F.lit(0)) / float(len(features))
    t = t.withColumns({"ml_signal": ml, "agent_consensus": agent, "dispersion": std, "feature_quality": good})
    x = F.round(F.greatest(F.least(F.col("ml_signal") * model_weight + F.col("agent_consensus") * agent_weight, F.lit(1.0)), F.lit(-1.0)), 9)
    level = F.when(x > 0.6, "strong_buy").when(x > 0.3, "buy").when(x > 0.1, "weak_buy").when(x < -0.6, "strong_sell").when(
        x < -0.3, "sell").when(x < -0.1, "weak_sell").otherwise("hold")
    a, b = F.col("ml_signal"), F.col("agent_consensus")
    conf = (1 - F.abs(a - b) / 2) * 0.3 + F.abs(a + b) / 2 * 0.3 + (1 - F.least(F.col("dispersion"), F.lit(1.0))) * 0.2 + F.col("feature_quality") * 0.2
    return t.withColumns({"combined": x, "decision": level, "decision_confidence": F.greatest(F.least(conf, F.lit(1.0)), F.lit(0.0))})


def adapted_weights(decisions: DataFrame, recent: int, old_model: float = MODEL_WEIGHT, old_agent: float = AGENT_WEIGHT) -> DataFrame:
    """Weights moved 30 percent toward the share of recent decisions each side got right."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    d = decisions.withColumn("_next", F.lead("combined").over(w)).withColumn("_i", F.row_number().over(back)).where(F.col("_i") <= recent)
    right = lambda c: F.sum(F.coalesce((F.signum(c) * F.signum("_next") > 0).cast("int"), F.lit(0)))
    g = d.groupBy("symbol").agg(right("ml_signal").alias("ml_right"), right("agent_consensus").alias("agent_right"))
    t = F.col("ml_right") + F.col("agent_right")
    m = F.when(t > 0, 0.7 * old_model + 0.3 * F.col("ml_right") / t).otherwise(old_model)
    a = F.when(t > 0, 0.7 * old_agent + 0.3 * F.col("agent_right") / t).otherwise(old_agent)
    return g.withColumns({"model_weight": m / (m + a), "agent_weight": a / (m + a)})


def reward(t: DataFrame) -> DataFrame:
    """Reward of an executed decision: scaled P&L plus flow accuracy, timing, against-flow penalty, confirmations.

    Needs action, confidence, pnl, movement, slippage, pattern, flow, flow_strength, confirmations.
    """
    a, mv = F.col("action"), F.col("movement")
    acc = F.when((a == "buy") & (mv > 0) | (a == "sell") & (mv < 0), F.least(F.abs(mv) * 10, F.lit(1.0))).when(
        (a == "hold") & (F.abs(mv) < 0.001), 0.5).otherwise(0.0) * F.col("confidence")
    slip = F.when(F.col("slippage") < 0.0001, 1.2).when(F.col("slippage") > 0.001, 0.8).otherwise(1.0)
    timing = F.when(F.col("pattern").isNull(), 0.0).otherwise(F.least(F.when(F.col("pattern") == "reversal", F.when(F.col("pnl") > 0, 1.0).otherwise(0.2)).otherwise(
        F.when(F.col("pnl") > 0, 0.8).otherwise(0.5)) * slip, F.lit(1.0)))
    against = (F.col("flow_strength") > 0.7) & (((F.col("flow") == "bullish") & (a == "sell")) | ((F.col("flow") == "bearish") & (a == "buy")))
    flow = acc * 5 + timing * 3 - F.when(against, 5).otherwise(0) + F.when(F.col("confirmations") >= 2, 2).otherwise(0)
    return t.withColumns({"flow_accuracy": acc, "timing": timing, "flow_reward": flow, "reward": F.col("pnl") * 10 + flow})


def adapt_thresholds(trades: DataFrame, base: float, min_trades: int) -> DataFrame:
    """Win rate per regime and the confidence limit after raising or lowering it."""
    g = trades.groupBy("regime").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("avg_pnl"))
    up, down = F.least(F.lit(base * 1.05), F.lit(0.8)), F.greatest(F.lit(base * 0.97), F.lit(0.40))
    few = F.col("trades") < min_trades
    return g.withColumn("threshold", F.when(few, F.lit(base)).when(F.col("win_rate") < 0.45, up).when(F.col("win_rate") > 0.60, down).otherwise(F.lit(base)))


@dataclass(frozen=True)
class AlertRule:
    """A user's predicate on one metric column."""

    name: str
    metric: str
    predicate: Column
    severity: str


def alerts(t: DataFrame, rules: list[AlertRule], cooldown: float, chunk_rows: int | None = None) -> DataFrame:
    """Alerts of all rules; a rule stays silent for ``cooldown`` seconds after it fired for a key.

    Which violation fires depends on the one before: the first one later than its time plus the cooldown.  Of
    equal times the smallest value fires.  See ``_jumps`` for rows beyond one chunk.
    """
    hit = F.array_compact(F.array(*[F.when(r.predicate, F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(r.metric).cast("double").alias("value"))) for r in rules]))
    v = t.select("symbol", "ts", F.explode(hit).alias("r")).select("symbol", "ts", "r.*")
    o = lay_out(v, ["symbol", "rule"], ["ts", "value"], chunk_rows)
    rows = o.chunked().withColumn("_us", F.unix_micros("ts")).drop("_own")
    wait = int(cooldown * 1e6)
    reached = rows.withColumn("_after", F.lit(BEFORE_ALL)) if o.single else rows.join(
        _jumps(rows, wait, o.chunk_rows).withColumnsRenamed({"_key": "_jkey", "_chunk": "_jchunk"}),
        (F.col("_key") == F.col("_jkey")) & (F.col("_chunk") == F.col("_jchunk"))).drop("_jkey", "_jchunk")
    fields = ["symbol", "ts", "rule", "severity", "value"]

    def fire(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rn")
        at, keep = group.column("_us").to_numpy(), []
        i = int(at.searchsorted(group.column("_after")[0].as_py(), "right"))
        while i < len(at):
            keep.append(i)
            i = int(at.searchsorted(at[i] + wait, "right"))
        return group.select(fields).take(pa.array(keep, pa.int64()))

    return reached.groupBy("_key", "_chunk").applyInArrow(fire, reached.select(*fields).schema).select(*v.columns)


#: A time before all others, in microseconds.
BEFORE_ALL = -(1 << 62)


def _jumps(rows: DataFrame, wait: int, chunk_rows: int) -> DataFrame:
    """``_key, _chunk, _after``: the chunks in which something fires, and the time after which their first violation fires.

    In a chunk every violation leads, from fire to fire, to a last one, whose time plus the cooldown is the
    chunk's exit.  Each distinct exit enters the first chunk with a later violation; an entry is a node, and its
    chunk tells by which exit it is left.  What the first node of a key reaches is found by doubling jumps, so an
    unbroken stretch over any number of chunks takes a logarithm of rounds and no group of its own.
    """
    def exits(at: np.ndarray) -> np.ndarray:
        following = at.searchsorted(at + wait, "right")
        last = np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            if following[i] < len(at):
                last[i] = last[following[i]]
        return at[last] + wait

    def leave(group: pa.Table) -> pa.Table:
        out = np.unique(exits(np.sort(group.column("_us").to_numpy())))
        return pa.table([pa.concat_arrays([group.column("_key").combine_chunks().slice(0, 1)]).take(pa.array(np.zeros(len(out), int))),
                         pa.array(np.full(len(out), group.column("_chunk")[0].as_py())), pa.array(out)], names=["_key", "_chunk", "_exit"])

    kind = T.StructType([rows.schema["_key"], T.StructField("_chunk", T.LongType()), T.StructField("_exit", T.LongType())])
    times = rows.select("_key", "_chunk", "_us")
    left = pin(times.groupBy("_key", "_chunk").applyInArrow(leave, kind))
    # The first chunk with a later violation: exits and the chunks' last times in one order, and the next chunk carried back.
    ends = pin(times.groupBy("_key", "_chunk").agg(F.max("_us").alias("_x")))
    none = F.lit(None).cast("long")
    stacked = ends.select("_key", "_x", F.lit(0).alias("_mark"), none.alias("_from"), F.col("_chunk").alias("_to")).unionByName(
        left.select("_key", F.col("_exit").alias("_x"), F.lit(1).alias("_mark"), F.col("_chunk").alias("_from"), none.alias("_to")))
    o = lay_out(stacked.withColumnRenamed("_key", "_k"), ["_k"], ["_x", "_mark", "_from", "_to"], chunk_rows)
    nodes = pin(o.running(o.chunked(), _next=("next", F.col("_to"))).where("_mark = 1 AND _next IS NOT NULL").select(
        F.col("_k").alias("_key"), F.col("_next").alias("_chunk"), F.col("_x").alias("_after")).distinct().unionByName(
        ends.groupBy("_key").agg(F.min("_chunk").alias("_chunk")).withColumn("_after", F.lit(BEFORE_ALL))))
    both = nodes.withColumnsRenamed({"_key": "_nkey", "_chunk": "_nchunk"})

    def enter(n: pa.Table, x: pa.Table) -> pa.Table:
        at = np.sort(x.column("_us").to_numpy())
        first = at.searchsorted(n.column("_after").to_numpy(), "right")  # a node enters a chunk that has a later violation
        return n.append_column("_exit", pa.array(exits(at)[first]))

    node = T.StructType([*both.schema.fields, T.StructField("_exit", T.LongType())])
    led = both.groupBy("_nkey", "_nchunk").cogroup(times.groupBy("_key", "_chunk")).applyInArrow(enter, node).select(
        F.struct("_nkey", "_nchunk", "_after").alias("_node"), F.struct("_nkey", "_exit").alias("_by"))
    # An exit's time tells its node within the key: the chunk it enters depends on nothing else.
    named = nodes.select(F.struct(F.col("_key").alias("_nkey"), F.col("_after").alias("_exit")).alias("_by"), F.struct(
        F.col("_key").alias("_nkey"), F.col("_chunk").alias("_nchunk"), "_after").alias("_goal"))
    jump = pin(led.join(named, "_by").select("_node", "_goal"))
    reached = pin(nodes.where(F.col("_after") == BEFORE_ALL).select(F.struct(F.col("_key").alias("_nkey"), F.col("_chunk").alias("_nchunk"), "_after").alias("_node")))
    while jump.limit(1).count():
        reached = pin(reached.unionByName(reached.join(jump, "_node").select(F.col("_goal").alias("_node"))).distinct())
        onward = jump.select(F.col("_node").alias("_goal"), F.col("_goal").alias("_far"))
        jump = pin(jump.join(onward, "_goal").select("_node", F.col("_far").alias("_goal")))
    return reached.select(F.col("_node._nkey").alias("_key"), F.col("_node._nchunk").alias("_chunk"), F.col("_node._after").alias("_after"))


def kelly_size(t: DataFrame, capital: float, risk_per_trade: float) -> DataFrame:
    """Kelly-based size with volatility, correlation, regime, confidence and drawdown factors.

    Needs win_rate, avg_win, avg_loss, close, volatility, correlation, regime, confidence, drawdown.
    """
    wr, aw, al = F.col("win_rate"), F.col("avg_win"), F.col("avg_loss")
    k = F.greatest(F.lit(0.0), F.least((wr * aw - (1 - wr) * al) / aw, F.lit(0.25)))
    v = F.col("volatility")
    vol = F.when(v > 0.04, 0.7).when(v > 0.025, 0.85).when(v < 0.01, 1.2).when(v < 0.015, 1.1).otherwise(1.0)
    cor = steps(F.col("correlation"), [(0.8, 0.6), (0.6, 0.75), (0.4, 0.9)], 1.0)
    c = F.col("confidence")
    reg = lookup(F.col("regime"), REGIME_SIZE, 0.9) * F.when(c < 0.6, 0.85).when(c > 0.8, 1.05).otherwise(1.0)
    con = F.least(F.when(c > 0.8, 1.2).when(c > 0.7, 1.1).when(c < 0.5, 0.7).when(c < 0.6, 0.85).otherwise(1.0), F.lit(1.5))
    dd = steps(F.col("drawdown"), [(0.1, 0.5), (0.05, 0.7), (0.02, 0.85)], 1.0)
    mult = F.greatest(F.lit(0.1), F.least(vol * cor * reg * con * dd, F.lit(2.0)))
    base = capital * risk_per_trade * k / F.col("close")
    return t.withColumns({"kelly": k, "multiplier": mult, "size": base * mult})


def blended_stop(t: DataFrame, market: Column, side: str) -> DataFrame:
    """Weighted mean of the ATR, volatility and support/resistance stops that exist, by market kind."""
    weight = lambda i: lookup(market, {k: v[i] for k, v in STOP_WEIGHTS.items()}, (0.33, 0.33, 0.34)[i])
    cand = [(F.col(f"{n}_{side}"), weight(i)) for i, n in enumerate(("atr", "vol", "sr"))]
    num = sum((F.when(v.isNotNull(), v * w).otherwise(0.0) for v, w in cand), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in cand), F.lit(0.0))
    return t.withColumn(f"stop_{side}", num / den)


def violations(t: DataFrame, limits: DataFrame) -> DataFrame:
    """How often confidence, direction and magnitude miss the limits of their regime (a four-row table)."""
    j = t.join(F.broadcast(limits), "regime")
    miss = lambda c, m: F.sum((F.coalesce(F.abs(c), F.lit(0.0)) < F.col(m)).cast("int"))
    return j.groupBy("regime").agg(miss("confidence", "min_confidence").alias("confidence"), miss("direction", "min_direction").alias("direction"),
                                   miss("magnitude", "min_magnitude").alias("magnitude"))


def model_vote(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence-weighted direction of several model rows per key, mean confidence and magnitude."""
    d, c = F.col("predicted") - 1.0, F.col("confidence")
    g = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("models"), (F.sum(d * c) / F.sum(c)).alias("direction"),
                                 F.avg(c).alias("mean_confidence"), F.stddev_pop(d).alias("_s"))
    return g.withColumn("magnitude", F.greatest(F.lit(0.001), F.abs("direction") * (1 - F.col("_s")))).drop("_s")
