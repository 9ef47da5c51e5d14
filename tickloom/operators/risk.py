"""Backtest outcomes, costs, returns, drawdowns and trade statistics over tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.history import grid
from tickloom.operators.ordered import Ordered, exact_quantiles, lay_out, time_values
from tickloom.operators.passage import barriers
from tickloom.operators.rangefold import DRAWDOWN, range_folds
from tickloom.operators.windows import corr, div, last_rows, pct_change, rmean, rstd
from tickloom.session import pin, small_side

# Cost multipliers (commission, slippage, spread) per backtest mode.
COST_MODES = [("simple", 1.0, 0.0, 0.0), ("realistic", 1.0, 1.0, 1.0),
              ("conservative", 1.2, 1.5, 1.5), ("stress", 1.5, 2.0, 2.0)]
TRADE_ORDER = ["exit_ts", "trade_id", "leg", "quantity", "pnl"]


def _w() -> Window:
    return Window.partitionBy("symbol").orderBy("ts")


def cross_signal(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Position 1 / -1 / 0 from two moving averages, known at the close of the bar."""
    w = _w()
    d = F.round(rmean(F.col("close"), w, fast) - rmean(F.col("close"), w, slow), 9)
    return bars.withColumn("position", F.coalesce(F.signum(d), F.lit(0.0)).cast("int"))


def outcomes(signals: DataFrame, sweep: list[tuple[float, float]], cost: float, holding: int | None = None,
             chunk_rows: int | None = None) -> DataFrame:
    """First barrier each signal meets in later bars of its day: stop, target, opposite signal, session end.

    A trade enters at the next bar's open.  ``holding`` closes it after so many bars with the reason
    ``holding_limit``.  ``sweep`` lists (stop, target) fractions and is a literal.  Overlap of trades
    is not resolved here.  Bars of a day are ordered in chunks; searches walk down block extremes
    (``passage``), so neither a signal nor a task holds the bars of a day.
    """
    day = signals.withColumn("_day", F.to_date("ts"))
    o = lay_out(day.select("symbol", "_day", "ts", "open", "high", "low", "close", "position"), ["symbol", "_day"], ["ts"], chunk_rows)
    side = F.col("position")
    entry = F.when(side != 0, F.lead("open").over(o.window) * (1 + side * cost))
    rows = o.chunked(after=1).withColumn("entry", entry).where("_own").drop("_own", "_chunk")
    rows = rows.join(small_side(o.sizes()), "_key").withColumn("entry", F.when(F.col("_rn") < F.col("_n"), F.col("entry")))
    s = barriers(Ordered(rows, tuple(rows.columns), o.chunk_rows, o.longest), sweep, holding)
    return s.select("symbol", "ts", "position", "stop", "target", "entry", "exit_ts", "reason", "exit",
                    (side * (F.col("exit") / F.col("entry") - 1) - cost).alias("ret"))


def per_day(trades: DataFrame, n: int) -> DataFrame:
    """The first n trades of each symbol, day and setting."""
    w = Window.partitionBy("symbol", F.to_date("ts"), "stop", "target").orderBy("ts")
    return trades.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def strategy_returns(signals: DataFrame) -> DataFrame:
    w = _w()
    r = F.lag("position").over(w) * pct_change(F.col("close"), w)
    return signals.withColumn("ret", F.coalesce(r, F.lit(0.0)))


def cost_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COST_MODES, "mode string, m_commission double, m_slippage double, m_spread double")


def costs(bars: DataFrame, commission: float, ticks: float, tick_value: float, quantity: Column) -> DataFrame:
    """Commission, slippage by volatility and volume, spread, hour adjustment and breakeven, per mode (four rows)."""
    b = bars.crossJoin(F.broadcast(cost_modes(bars.sparkSession))).withColumn("quantity", quantity)
    vol = 1 + (F.col("high") - F.col("low")) / F.col("close") * 10
    thin = F.when(F.col("volume") < 100, 2.0).when(F.col("volume") < 200, 1.5).otherwise(1.0)
    h = F.hour("ts")
    hour = F.when((h < 9) | (h > 17), 1.5).when((h == 9) | (h == 17), 1.2).otherwise(1.0)
    q = F.col("quantity")
    b = b.withColumns({
        "commission": commission * q * F.col("m_commission") * 2,
        "slippage": ticks * tick_value * F.col("m_slippage") * vol * thin * 2 * q,
        "spread": (F.col("high") - F.col("low")) / 2 * q * F.col("m_spread")})
    b = b.withColumn("total", F.col("commission") + F.col("slippage") + F.col("spread"))
    return b.withColumns({"adjusted": F.col("total") * hour, "long_breakeven": F.col("close") + F.col("total") / q,
                          "short_breakeven": F.col("close") - F.col("total") / q})


def equity(trades: DataFrame, key: str, start: float, chunk_rows: int | None = None) -> tuple[Ordered, DataFrame]:
    """Running equity, its peak and drawdown per trade, in exit order."""
    o = lay_out(trades, [key], TRADE_ORDER, chunk_rows)
    e = o.running_peak(o.chunked(), F.col("pnl"), "_cum", "_top").withColumns({
        "equity": F.lit(start) + F.col("_cum"), "peak": F.lit(start) + F.col("_top")})
    return o, e.withColumns({"drawdown": F.col("equity") - F.col("peak"), "drawdown_pct": F.try_divide(F.col("equity") - F.col("peak"), F.col("peak"))})


def drawdown_periods(trades: DataFrame, key: str, start: float, chunk_rows: int | None = None) -> DataFrame:
    """One row per stay below a peak: first and last exit, depth, number of trades, recovered or not."""
    o, e = equity(trades, key, start, chunk_rows)
    # pinned: the next pass reads the curve twice
    e = o.running(pin(e), period=("sum", (F.col("equity") >= F.col("peak")).cast("long")))
    below = e.where(F.col("equity") < F.col("peak"))
    top = e.groupBy(key).agg(F.max("period").alias("_top"))
    return below.groupBy(key, "period").agg(
        F.min("exit_ts").alias("start"), F.max("exit_ts").alias("end"), F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("trades")
    ).join(top, key).withColumn("recovered", (F.col("period") < F.col("_top")).cast("int")).drop("_top")


def drawdown_metrics(trades: DataFrame, key: str, start: float, chunk_rows: int | None = None) -> DataFrame:
    o, e = equity(trades, key, start, chunk_rows)
    at_end = F.max_by(F.col("drawdown"), F.col("_rn"))
    return e.groupBy(key).agg(
        F.min("drawdown").alias("max_drawdown"), F.min("drawdown_pct").alias("max_drawdown_pct"), at_end.alias("current_drawdown"),
        F.max_by("equity", F.col("_rn")).alias("final_equity"), F.sum((F.col("drawdown") < 0).cast("int")).alias("trades_below_peak"))


def return_metrics(returns: DataFrame, keys: list[str], year: int = 252) -> DataFrame:
    """Total and annual return, Sharpe, Sortino, Calmar and information ratio of ordered ``ret``.

    Needs ``benchmark`` for the information ratio.  Drawdown comes from the compounded curve, so
    the input is a clock-bounded series per key.
    """
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    r = returns.withColumn("_log", F.sum(F.log1p("ret")).over(w))
    r = r.withColumn("_dd", F.exp(F.col("_log") - F.greatest(F.max("_log").over(w), F.lit(0.0))) - 1)
    n, x = F.count("ret"), F.col("ret")
    excess = x - F.col("benchmark")
    g = r.groupBy(*keys).agg(
        n.alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"),
        F.stddev_samp(F.when(x < 0, x)).alias("_d"), (-F.min("_dd")).alias("max_drawdown"), F.avg(excess).alias("_em"), F.stddev_samp(excess).alias("_es"))
    annual = F.pow(1 + F.col("total"), F.lit(float(year)) / F.col("n")) - 1
    root = math.sqrt(year)
    return g.withColumns({
        "annual": annual, "sharpe": F.try_divide("_m", "_s") * root, "sortino": F.try_divide("_m", "_d") * root,
        "calmar": F.try_divide(annual, F.col("max_drawdown")), "information": F.try_divide("_em", "_es") * root}).drop("_m", "_s", "_d", "_em", "_es")


def value_at_risk(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """VaR and CVaR at 95 and 99 percent from exact quantiles."""
    q = exact_quantiles(df, keys, col, {"var_95": 0.05, "var_99": 0.01})
    x = F.col(col)
    return df.join(small_side(q), keys).groupBy(*keys, "var_95", "var_99").agg(
        F.avg(F.when(x <= F.col("var_95"), x)).alias("cvar_95"), F.avg(F.when(x <= F.col("var_99"), x)).alias("cvar_99"))


def trade_statistics(trades: DataFrame, keys: list[str], commission: float = 0.0) -> DataFrame:
    """Win rate, profit factor, payoff, expectancy, capped Kelly share, extremes and holding time."""
    p = F.col("pnl") - commission * F.col("quantity")
    t = trades.withColumn("_p", p)
    win, loss = F.col("_p") > 0, F.col("_p") < 0
    hold = (F.unix_seconds("exit_ts") - F.unix_seconds("entry_ts")) / 86400.0
    g = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.sum(F.when(win, F.col("_p")).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(loss, -F.col("_p")).otherwise(0.0)).alias("_pain"), F.avg(F.when(win, F.col("_p"))).alias("avg_win"), F.avg(F.when(loss, -F.col("_p"))).alias("avg_loss"),
        F.avg("_p").alias("expectancy"), F.max("_p").alias("best"), F.min("_p").alias("worst"), F.avg(hold).alias("days_held"), F.sum("_p").alias("net"))
    payoff = F.try_divide("avg_win", "avg_loss")
    kelly = F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), payoff)
    return g.withColumns({"profit_factor": F.try_divide("_gain", "_pain"), "payoff": payoff,
                          "kelly": F.greatest(F.lit(0.0), F.least(kelly, F.lit(0.25)))}).drop("_gain", "_pain")


def distribution_shape(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Skewness and excess kurtosis by population moments, and omega at zero."""
    m = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    z = (F.col(col) - F.col("_m")) / F.col("_s")
    x = F.col(col)
    return df.join(small_side(m), keys).groupBy(*keys).agg(
        F.avg(z * z * z).alias("skewness"), (F.avg(z * z * z * z) - 3).alias("kurtosis"),
        F.try_divide(F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))).alias("omega"))


def extract_trades(signals: DataFrame) -> DataFrame:
    """Trades as runs of one non-zero position over bars: entry, exit, length, return."""
    w = _w()
    s = strategy_returns(signals).withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    s = s.withColumn("_new", F.coalesce((F.col("held") != F.lag("held").over(w)).cast("int"), F.lit(1)))
    s = s.withColumn("trade", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where("held <> 0").groupBy("symbol", "trade", "held").agg(
        F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.count(F.lit(1)).alias("bars"), F.sum("ret").alias("ret"))


def breakdown(trades: DataFrame, bucket: Column, name: str) -> DataFrame:
    return trades.groupBy(bucket.alias(name)).agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("avg_pnl"))


def duration_bucket() -> Column:
    days = F.datediff("exit_ts", "entry_ts")
    return F.when(days <= 7, "week").when(days <= 30, "month").when(days <= 365, "year").otherwise("longer")


def streaks(trades: DataFrame, key: str, chunk_rows: int | None = None) -> DataFrame:
    """Longest runs of wins and of losses in exit order."""
    o = lay_out(trades, [key], TRADE_ORDER, chunk_rows)
    rows = o.chunked(before=1).withColumn("win", (F.col("pnl") > 0).cast("int"))
    rows = rows.withColumn("_ch", (~F.lag("win").over(o.window).eqNullSafe(F.col("win"))) | (F.col("_rn") == 1))
    out = o.running(rows, _from=("max", F.when(F.col("_ch"), F.col("_rn"))))
    n = F.col("_rn") - F.col("_from") + 1
    return out.groupBy(key).agg(F.max(F.when(F.col("win") == 1, n)).alias("longest_wins"), F.max(F.when(F.col("win") == 0, n)).alias("longest_losses"))


def excursions(trades: DataFrame, day_bars: DataFrame) -> DataFrame:
    """Worst and best price of the key's daily bars during each trade.

    Daily bars per key are bounded by the calendar.  For each power of two the extremes of the
    following 2^k days are kept per day, as many powers as the longest series needs, so two
    look-ups by (key, power, day) answer any holding period and trades are never paired with days.
    """
    spans = pin(day_bars.groupBy("symbol").agg(F.to_date(F.min("ts")).alias("_first"), F.datediff(F.max("ts"), F.min("ts")).alias("_span")))
    levels = int(spans.agg(F.max("_span")).first()[0] or 0).bit_length() + 1
    g = grid(day_bars.select("symbol", "ts", "high", "low"), 24 * 60)
    w = Window.partitionBy("symbol").orderBy("ts")
    g = g.withColumns({"_h0": F.col("high"), "_l0": F.col("low"), "_day": F.row_number().over(w) - 1})
    for k in range(1, levels):  # each level joins two neighbouring blocks of the level before
        half = 2 ** (k - 1)
        g = g.withColumns({
            f"_h{k}": F.greatest(f"_h{k - 1}", F.lead(f"_h{k - 1}", half).over(w)),
            f"_l{k}": F.least(f"_l{k - 1}", F.lead(f"_l{k - 1}", half).over(w))})
    table = small_side(g.select("symbol", "_day", F.posexplode(F.array(*[F.struct(F.col(f"_h{k}").alias("h"), F.col(f"_l{k}").alias("l")) for k in range(levels)])).alias(
        "_k", "_x")).select("symbol", "_k", "_day", "_x.h", "_x.l"))
    t = trades.join(small_side(spans), F.col("regime") == F.col("symbol"), "left").drop("symbol")
    a = F.datediff("entry_ts", "_first") + (F.col("entry_ts") > F.date_trunc("day", "entry_ts")).cast("int")
    t = t.withColumns({"_a": F.greatest(a, F.lit(0)), "_b": F.least(F.datediff("exit_ts", "_first"), F.col("_span"))})
    n = F.col("_b") - F.col("_a") + 1
    t = t.withColumn("_k", F.when(n >= 1, F.floor(F.log2(n.cast("double"))).cast("int")))
    t = t.withColumn("_second", F.col("_b") - F.expr("shiftleft(1, _k)") + 1)
    for at, name in (("_a", "1"), ("_second", "2")):
        side = table.select(F.col("symbol").alias("_s"), F.col("_k").alias("_kk"), F.col("_day").alias("_d"), F.col("h").alias(f"_h{name}"), F.col("l").alias(f"_l{name}"))
        t = t.join(side, (t["regime"] == side["_s"]) & (t["_k"] == side["_kk"]) & (t[at] == side["_d"]), "left").drop("_s", "_kk", "_d")
    return t.withColumns({"high": F.greatest("_h1", "_h2"), "low": F.least("_l1", "_l2")}).drop(
        "_h1", "_l1", "_h2", "_l2", "_first", "_span", "_a", "_b", "_k", "_second")


def roll_up(fills: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Net quantity, cash, value and the round trip (between flat points) of each fill."""
    o = lay_out(fills, ["symbol"], ["ts", "seq"], chunk_rows)
    q = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1).otherwise(0)
    rows = o.running(o.chunked(), net=("sum", q.cast("long")), cash=("sum", -q * F.col("price")))
    rows = o.running(pin(rows), trip=("sum", (F.col("net") == 0).cast("long")), realised=("last", F.when(F.col("net") == 0, F.col("cash"))))
    return rows.withColumns({
        "trip": F.when(F.col("net") == 0, F.col("trip") - 1).otherwise(F.col("trip")), "realised": F.coalesce("realised", F.lit(0.0)),
        "value": F.col("cash") + F.col("net") * F.col("price"),
        "unrealised": F.col("cash") + F.col("net") * F.col("price") - F.coalesce("realised", F.lit(0.0))})


def limit_check(metrics: DataFrame, keys: list[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Names of the limits a row breaks; ``limits`` maps a metric to ('max'|'min', value)."""
    broken = F.array_compact(F.array(*[
        F.when(F.col(m) > x if how == "max" else F.col(m) < x, F.lit(m)) for m, (how, x) in limits.items()]))
    return metrics.select(*keys, broken.alias("violations")).withColumn("ok", (F.size("violations") == 0).cast("int"))


def compare_runs(live: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of values and match rate of signals between two runs on common keys."""
    j = live.alias("l").join(test.alias("t"), keys)
    return j.groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("n"), corr(F.col("l.price"), F.col("t.price")).alias("correlation"),
        F.avg((F.col("l.side") == F.col("t.side")).cast("double")).alias("match_rate"), F.avg(F.abs(F.col("l.price") - F.col("t.price"))).alias("mean_diff"))


def rolling_correlation(bars: DataFrame, n: int, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation of bar returns over the last n common bars, for the given ``pairs`` of symbols."""
    w = _w()
    r = bars.select("symbol", "ts", pct_change(F.col("close"), w).alias("ret")).where("ret IS NOT NULL")
    roles = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(s).alias("s")) for a, b in pairs for s in (a, b)])
    own = r.withColumn("_p", F.explode(F.filter(roles, lambda p: p.s == F.col("symbol")))).select("_p.a", "_p.b", "ts", "symbol", "ret")
    both = own.groupBy("a", "b", "ts").agg(*[F.max(F.when(F.col("symbol") == F.col(c), F.col("ret"))).alias(f"r{c}") for c in ("a", "b")]).where(
        "ra IS NOT NULL AND rb IS NOT NULL")
    f = last_rows(Window.partitionBy("a", "b").orderBy("ts"), n)
    return both.select("a", "b", "ts", F.when(F.count("ra").over(f) >= n, corr(F.col("ra"), F.col("rb"), f)).alias("correlation"))


def volatility_forecast(bars: DataFrame, horizon: int, speed: float = 0.1) -> DataFrame:
    """Twenty-bar volatility pulled toward the long-run one, scaled to a horizon in minutes."""
    w = _w()
    b = bars.withColumn("_r", pct_change(F.col("close"), w))
    long_run = small_side(b.groupBy("symbol").agg(F.stddev_samp("_r").alias("_long")))
    b = b.withColumn("current", rstd(F.col("_r"), w, 20)).join(long_run, "symbol")
    return b.withColumn("forecast", (F.col("current") + speed * (F.col("_long") - F.col("current"))) * math.sqrt(horizon / 1440))


def rolling_trades(trades: DataFrame, key: str, seconds: float, chunk_rows: int | None = None) -> DataFrame:
    """Count, win rate, P&L, Sharpe and maximum drawdown of the trades closed in the last ``seconds``.

    The drawdown is the largest fall of the running P&L of the window's trades, in closing order, from a
    high to a later value; trades closed at the same time are all in the window.
    """
    o = lay_out(trades, [key], TRADE_ORDER, chunk_rows)
    p, at = F.col("pnl"), Window.partitionBy("_key", "_chunk", "exit_ts").orderBy("_rn")
    fraction = isinstance(trades.schema["pnl"].dataType, (T.DoubleType, T.FloatType))
    exact = lambda x: x.cast("decimal(28,10)") if fraction else x
    known = F.nanvl(p.cast("double"), F.lit(None))
    rows = o.chunked().select(F.col(key), "exit_ts", "pnl", "_key", "_chunk", "_rn")
    rows = rows.withColumn("_cum", F.sum(known).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_peak", F.max("_cum").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    # one row per time and chunk: what its trades add, and their running P&L folded as a run
    runs = pin(rows.groupBy(key, "exit_ts", F.col("_chunk").alias("_run")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum((p > 0).cast("int")).alias("_w"), F.sum(exact(p)).alias("_p"), F.sum(exact(p * p)).alias("_pp"),
        F.sum(known).alias("_total"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"), F.max(F.col("_peak") - F.col("_cum")).alias("_fall")))
    sums = {"_runs": F.lit(1), "n": F.col("_n"), "win": F.col("_w"), "total": F.col("_p"), "_ss": F.col("_pp")}
    times = time_values(runs, [key], "exit_ts", {n: ("sum", c, seconds) for n, c in sums.items()}, chunk_rows=chunk_rows)
    laid = lay_out(times, [key], ["exit_ts", "_run"], chunk_rows)
    later = F.lead("exit_ts").over(laid.window)
    ends = laid.finish(laid.chunked(after=1).withColumn("_last", ~later.eqNullSafe(F.col("exit_ts"))), *laid.rows.columns, "_last")
    parts = [F.coalesce(F.col(c), F.lit(e)) for c, e in zip(("_total", "_high", "_low", "_fall"), DRAWDOWN.empty, strict=True)]
    first = F.when(F.col("_last"), F.col("_rn") - F.col("_runs") + 1)
    folded = range_folds(Ordered(ends, tuple(ends.columns), laid.chunk_rows, laid.longest), {"max_drawdown": (first, parts, DRAWDOWN)})
    number = lambda c: F.col(c).cast("double") if fraction else F.col(c)
    folded = folded.where("_last").select(F.struct("_key", "exit_ts").alias("_at"), "n", "win", number("total").alias("total"), number("_ss").alias("_ss"), "max_drawdown")
    t = o.rows.withColumn("_at", F.struct("_key", "exit_ts")).join(small_side(folded), "_at").drop("_at", "_key", "_rn")
    mean = F.col("total") / F.col("n")
    std = F.sqrt(F.greatest((F.col("_ss") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    return t.withColumns({"win_rate": F.col("win") / F.col("n"), "sharpe": F.when(F.col("n") >= 2, F.try_divide(mean, std))}).drop("win", "_ss")


def excursion_statistics(trades: DataFrame) -> DataFrame:
    """Of the adverse and the favourable excursions of trades: number, mean, largest, and exact quartiles.

    Needs side (long or short), entry_price, and the lowest and highest price during each trade (``excursions``).
    Excursions of the wrong sign don't count; without any, a kind has no row.
    """
    long = F.col("side") == "long"
    down, up = F.col("low") - F.col("entry_price"), F.col("high") - F.col("entry_price")
    both = trades.select(F.explode(F.array(
        F.struct(F.lit("mae").alias("kind"), (-F.when(long, down).otherwise(-up)).alias("size")),
        F.struct(F.lit("mfe").alias("kind"), F.when(long, up).otherwise(-down).alias("size")))).alias("x")).select("x.*").where("size > 0")
    both = pin(both)
    whole = both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"), F.max("size").alias("largest"))
    return whole.join(exact_quantiles(both, ["kind"], "size", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "kind")


def circuit_breaks(trades: DataFrame, key: str, day_loss: float, max_drawdown: float, mean_abs: float, chunk_rows: int | None = None) -> DataFrame:
    """First breach per day: daily loss, drawdown, five losses in a row, large mean move of ten trades.

    Daily loss accumulates inside the day in exit order.
    """
    o = lay_out(trades, [key], TRADE_ORDER, chunk_rows)
    p = F.col("pnl")
    w5, w10 = o.last(5), o.last(10)
    rows = o.chunked(before=10).withColumns({
        "_l5": F.when(F.count(p).over(w5) >= 5, F.max(p).over(w5) < 0), "_m10": F.when(F.count(p).over(w10) >= 10, F.avg(F.abs(p)).over(w10)),
        "_day": F.to_date("exit_ts"), "_newday": ~F.lag(F.to_date("exit_ts")).over(o.window).eqNullSafe(F.to_date("exit_ts"))})
    e = o.running_peak(rows, p, "_cum", "_peak")
    e = o.running(pin(e), _before=("last", F.when(F.col("_newday"), F.col("_cum") - p)))
    reason = F.when(F.col("_cum") - F.col("_before") < -day_loss, "daily_loss").when(F.col("_cum") - F.col("_peak") < -max_drawdown, "drawdown").when(
        F.col("_l5"), "consecutive_losses").when(F.col("_m10") > mean_abs, "volatility")
    hit = e.withColumn("reason", reason).where("reason IS NOT NULL")
    return hit.groupBy(key, F.col("_day").alias("day")).agg(F.min_by("reason", F.col("_rn")).alias("first_reason"), F.count(F.lit(1)).alias("breaches"))


def trailing_stops(signals: DataFrame, points: float, lock: float) -> DataFrame:
    """Stop level of the open trade at each bar; locks in profit once the best profit passes ``points``."""
    w = _w()
    s = signals.withColumn("held", F.coalesce(F.lag("position").over(w), F.lit(0)))
    s = s.withColumn("_new", F.coalesce((F.col("held") != F.lag("held").over(w)).cast("int"), F.lit(1)))
    s = s.withColumn("trade", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("held <> 0")
    t = Window.partitionBy("symbol", "trade").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.first("open").over(t)
    s = s.withColumn("entry", entry)
    best = F.max(F.col("held") * (F.col("close") - F.col("entry"))).over(t)
    return s.withColumn("stop", F.when(best >= points, F.col("entry") + F.col("held") * lock).otherwise(F.col("entry") * (1 - F.col("held") * 0.02)))
