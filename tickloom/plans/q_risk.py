"""Backtest and risk analytics (K01-K19) and circuit breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import risk as rk
from tickloom.operators.windows import by_time, pct_change
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import W, flag, fr, lag, mean, std

EX = "PARTITION BY regime ORDER BY exit_ts, trade_id, leg, quantity, pnl"
SIG = f"sg AS (SELECT *, CAST(coalesce(sign(round({mean('close', 5)} - {mean('close', 20)}, 9)), 0) AS INT) AS pos FROM barx)"


def signals(spark, sf):
    return rk.cross_signal(v.bars(spark, sf))


OUT = f"""
WITH {SIG}, p AS (SELECT * FROM (VALUES (0.05::DOUBLE, 0.1::DOUBLE), (0.2, 0.4)) t(stop, target)),
j AS (SELECT s.symbol, s.ts, s.pos, p.stop, p.target, b.ts AS bts, b.high, b.low, b.close, b.open, b.pos AS bpos, row_number() OVER (PARTITION BY s.symbol, s.ts, p.stop ORDER BY b.ts) AS i,
 count(*) OVER (PARTITION BY s.symbol, s.ts, p.stop) AS n FROM sg s JOIN sg b ON s.symbol = b.symbol AND CAST(s.ts AS DATE) = CAST(b.ts AS DATE) AND b.rn > s.rn, p WHERE s.pos <> 0),
e AS (SELECT *, first_value(open) OVER (PARTITION BY symbol, ts, stop ORDER BY bts) * (1 + pos * 0.0005::DOUBLE) AS entry FROM j),
k AS (SELECT *, entry * (1 - pos * stop) AS sp, entry * (1 + pos * target) AS tp FROM e),
m AS (SELECT *, CASE WHEN (pos > 0 AND low <= sp) OR (pos < 0 AND high >= sp) THEN 'stop' WHEN (pos > 0 AND high >= tp) OR (pos < 0 AND low <= tp) THEN 'target' WHEN bpos = -pos THEN 'opposite' WHEN i = n THEN 'session_end' END AS reason FROM k),
f AS (SELECT *, CASE reason WHEN 'stop' THEN sp WHEN 'target' THEN tp ELSE close END AS px FROM m WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts, stop ORDER BY bts) = 1)
"""


@query("k01_barrier_outcomes", OUT + f"SELECT symbol, ts, pos AS position, stop, target, {r('entry', 8)} AS entry, bts AS exit_ts, reason, {r('px', 8)} AS exit, {r('pos * (px / entry - 1) - 0.0005', 8)} AS ret FROM f")
def _(spark, sf):
    return rk.outcomes(signals(spark, sf), [(0.05, 0.1), (0.2, 0.4)], 0.0005).withColumns({c: rd(c, 8) for c in ("entry", "exit", "ret")})


@query("k01_trades_per_day", OUT + f"SELECT symbol, ts, stop, reason, {r('pos * (px / entry - 1) - 0.0005')} AS ret FROM f QUALIFY row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE), stop ORDER BY ts) <= 3")
def _(spark, sf):
    return rk.per_day(rk.outcomes(signals(spark, sf), [(0.05, 0.1), (0.2, 0.4)], 0.0005), 3).select("symbol", "ts", "stop", "reason", rd("ret").alias("ret"))


@query("k02_strategy_returns", f"WITH {SIG} SELECT symbol, ts, pos AS position, {r('coalesce(' + lag('pos') + ' * ret, 0)')} AS ret FROM sg")
def _(spark, sf):
    return rk.strategy_returns(signals(spark, sf)).select("symbol", "ts", "position", rd("ret").alias("ret"))


@query("k03_costs", f"""
WITH m AS (SELECT * FROM (VALUES ('simple', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('realistic', 1.0, 1.0, 1.0), ('conservative', 1.2, 1.5, 1.5), ('stress', 1.5, 2.0, 2.0)) t(mode, mc, ms, mp)),
a AS (SELECT *, 2.5::DOUBLE * trades * mc * 2 AS c, 1.0 * 0.5::DOUBLE * ms * (1 + (high - low) / close * 10) * CASE WHEN volume < 100 THEN 2.0 WHEN volume < 200 THEN 1.5 ELSE 1.0 END * 2 * trades AS s, (high - low) / 2 * trades * mp AS p FROM bars, m),
b AS (SELECT *, c + s + p AS t FROM a)
SELECT symbol, ts, mode, {r("c")} AS commission, {r("s")} AS slippage, {r("p")} AS spread, {r("t * CASE WHEN extract(hour FROM ts) < 9 OR extract(hour FROM ts) > 17 THEN 1.5 WHEN extract(hour FROM ts) IN (9, 17) THEN 1.2 ELSE 1 END")} AS adjusted,
 {r("close + t / trades")} AS long_breakeven, {r("close - t / trades")} AS short_breakeven FROM b""")
def _(spark, sf):
    return rk.costs(v.bars(spark, sf), 2.5, 1.0, 0.5, F.col("trades")).select("symbol", "ts", "mode", *[rd(c).alias(c) for c in ("commission", "slippage", "spread", "adjusted", "long_breakeven", "short_breakeven")])


EQ = f"WITH e0 AS (SELECT *, 1e6 + sum(pnl) OVER ({EX} ROWS UNBOUNDED PRECEDING) AS eq, row_number() OVER ({EX}) AS rn FROM closed_trades), e AS (SELECT *, max(eq) OVER ({EX} ROWS UNBOUNDED PRECEDING) AS peak FROM e0)"


@query("k04_equity_curve", EQ + f" SELECT regime, trade_id, leg, {r('pnl', 4)} AS pnl, {r('eq', 4)} AS equity, {r('eq - peak', 4)} AS drawdown FROM e")
def _(spark, sf):
    _, e = rk.equity(v.closed_trades(spark, sf), "regime", 1e6)
    return e.select("regime", "trade_id", "leg", rd("pnl", 4).alias("pnl"), rd("equity", 4).alias("equity"), rd("drawdown", 4).alias("drawdown"))


@query("k06_drawdown_metrics", EQ + f""" SELECT regime, {r("min(eq - peak)", 4)} AS max_drawdown, {r("min((eq - peak) / peak)")} AS max_drawdown_pct, {r("arg_max(eq - peak, rn)", 4)} AS current_drawdown,
 {r("arg_max(eq, rn)", 4)} AS final_equity, CAST(sum(CASE WHEN eq < peak THEN 1 ELSE 0 END) AS BIGINT) AS trades_below_peak FROM e GROUP BY 1""")
def _(spark, sf):
    return rk.drawdown_metrics(v.closed_trades(spark, sf), "regime", 1e6).select("regime", "trades_below_peak", rd("max_drawdown_pct").alias("max_drawdown_pct"),
        *[rd(c, 4).alias(c) for c in ("max_drawdown", "current_drawdown", "final_equity")])


@query("k06_drawdown_periods", EQ + f""", p AS (SELECT *, sum(CASE WHEN eq >= peak THEN 1 ELSE 0 END) OVER ({EX} ROWS UNBOUNDED PRECEDING) AS period FROM e)
SELECT regime, CAST(p.period AS BIGINT) AS period, min(exit_ts) AS start, max(exit_ts) AS "end", {r("min(eq - peak)", 4)} AS depth, count(*) AS trades, {flag("max(p.period) < max(t)")} AS recovered
FROM p JOIN (SELECT regime AS rg, max(period) AS t FROM p GROUP BY 1) ON regime = rg WHERE eq < peak GROUP BY regime, p.period""")
def _(spark, sf):
    return rk.drawdown_periods(v.closed_trades(spark, sf), "regime", 1e6).withColumn("depth", rd("depth", 4))


RET = """WITH a AS (SELECT symbol, ts, (close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) / 10 AS ret FROM day_bars), b AS (SELECT ts AS bt, avg(ret) AS bm FROM a WHERE ret IS NOT NULL GROUP BY 1),
c AS (SELECT * FROM a JOIN b ON ts = bt WHERE ret IS NOT NULL), d AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY ts) AS lg FROM c),
e AS (SELECT *, exp(lg - greatest(max(lg) OVER (PARTITION BY symbol ORDER BY ts), 0)) - 1 AS dd FROM d),
m AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total, -min(dd) AS mdd, avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) AS sharpe, avg(ret) / stddev_samp(ret) FILTER (ret < 0) * sqrt(252.0::DOUBLE) AS sortino,
 avg(ret - bm) / stddev_samp(ret - bm) * sqrt(252.0::DOUBLE) AS information FROM e GROUP BY 1)"""


def _returns(spark, sf):
    d = v.day_bars(spark, sf)
    x = d.select("symbol", "ts", (pct_change(F.col("close"), by_time("symbol")) / 10).alias("ret")).where("ret IS NOT NULL")
    return x.join(x.groupBy("ts").agg(F.avg("ret").alias("benchmark")), "ts")


@query("k05_return_metrics", RET + f" SELECT symbol, n, {r('ln(1 + total)')} AS log_total, {r('ln(1 + total) * 252 / n')} AS log_annual, {r('mdd')} AS max_drawdown, {r('sharpe')} AS sharpe, {r('sortino')} AS sortino, {r('information')} AS information FROM m")
def _(spark, sf):
    return rk.return_metrics(_returns(spark, sf), ["symbol"]).select("symbol", "n", rd(F.log1p("total")).alias("log_total"), rd(F.log1p("annual")).alias("log_annual"),
        *[rd(c).alias(c) for c in ("max_drawdown", "sharpe", "sortino", "information")])


@query("k15_limit_check", RET + " SELECT symbol, concat_ws(',', CASE WHEN mdd > 0.9 THEN 'max_drawdown' END, CASE WHEN sharpe < 9 THEN 'sharpe' END) AS violations, CASE WHEN mdd > 0.9 OR sharpe < 9 THEN 0 ELSE 1 END AS ok FROM m")
def _(spark, sf):
    return rk.limit_check(rk.return_metrics(_returns(spark, sf), ["symbol"]), ["symbol"], {"max_drawdown": ("max", 0.9), "sharpe": ("min", 9.0)}).withColumn("violations", F.concat_ws(",", "violations"))


@query("k07_value_at_risk", f"""
WITH q AS (SELECT regime AS g, quantile_cont(pnl, 0.05) AS v5, quantile_cont(pnl, 0.01) AS v1 FROM closed_trades GROUP BY 1)
SELECT regime, {r("v5", 4)} AS var_95, {r("v1", 4)} AS var_99, {r("avg(pnl) FILTER (pnl <= v5)", 4)} AS cvar_95, {r("avg(pnl) FILTER (pnl <= v1)", 4)} AS cvar_99 FROM closed_trades JOIN q ON regime = g GROUP BY 1, v5, v1""")
def _(spark, sf):
    return rk.value_at_risk(v.closed_trades(spark, sf), ["regime"], "pnl").select("regime", *[rd(c, 4).alias(c) for c in ("var_95", "var_99", "cvar_95", "cvar_99")])


def _stats(key):
    return f"""WITH a AS (SELECT *, pnl - 1.5::DOUBLE * quantity AS p FROM closed_trades), b AS (SELECT {key}, count(*) AS trades, avg(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS wr, sum(p) FILTER (p > 0) / -sum(p) FILTER (p < 0) AS pf, avg(p) FILTER (p > 0) AS aw,
 -avg(p) FILTER (p < 0) AS al, avg(p) AS ex, max(p) AS best, min(p) AS worst, avg(epoch(exit_ts) - epoch(entry_ts)) / 86400 AS dh FROM a GROUP BY 1)
SELECT {key}, trades, {r("wr")} AS win_rate, {r("pf")} AS profit_factor, {r("aw", 4)} AS avg_win, {r("al", 4)} AS avg_loss, {r("aw / al")} AS payoff, {r("ex", 4)} AS expectancy, {r("greatest(0, least(wr - (1 - wr) / (aw / al), 0.25))")} AS kelly,
 {r("best", 4)} AS best, {r("worst", 4)} AS worst, {r("dh", 5)} AS days_held FROM b"""


for _key in ("regime", "side"):
    def _st(spark, sf, key=_key):
        return rk.trade_statistics(v.closed_trades(spark, sf), [key], 1.5).select(key, "trades", *[rd(c).alias(c) for c in ("win_rate", "profit_factor", "payoff", "kelly")],
            rd("days_held", 5).alias("days_held"), *[rd(c, 4).alias(c) for c in ("avg_win", "avg_loss", "expectancy", "best", "worst")])
    query("k08_k12_trade_statistics_" + _key, _stats(_key))(_st)


@query("k09_distribution_shape", f"""
WITH m AS (SELECT regime AS g, avg(pnl) AS mu, stddev_pop(pnl) AS sd FROM closed_trades GROUP BY 1)
SELECT regime, {r("avg(pow((pnl - mu) / sd, 3))")} AS skewness, {r("avg(pow((pnl - mu) / sd, 4)) - 3")} AS kurtosis, {r("sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END)")} AS omega FROM closed_trades JOIN m ON regime = g GROUP BY 1""")
def _(spark, sf):
    return rk.distribution_shape(v.closed_trades(spark, sf), ["regime"], "pnl").select("regime", *[rd(c).alias(c) for c in ("skewness", "kurtosis", "omega")])


HELD = f"""{SIG}, h AS (SELECT *, coalesce({lag("pos")}, 0) AS held, coalesce({lag("pos")} * ret, 0) AS sr FROM sg), n AS (SELECT *, coalesce(CAST(held <> {lag("held")} AS INT), 1) AS nw FROM h), t AS (SELECT *, sum(nw) OVER {W} AS trade FROM n)"""


@query("k10_extracted_trades", f"WITH {HELD} SELECT symbol, CAST(trade AS BIGINT) AS trade, held, min(ts) AS entry_ts, max(ts) AS exit_ts, count(*) AS bars, {r('sum(sr)')} AS ret FROM t WHERE held <> 0 GROUP BY 1, 2, 3")
def _(spark, sf):
    return rk.extract_trades(signals(spark, sf)).withColumn("ret", rd("ret"))


BUCKETS = {"duration": (rk.duration_bucket, "CASE WHEN date_diff('day', entry_ts, exit_ts) <= 7 THEN 'week' WHEN date_diff('day', entry_ts, exit_ts) <= 30 THEN 'month' WHEN date_diff('day', entry_ts, exit_ts) <= 365 THEN 'year' ELSE 'longer' END"),
           "weekday": (lambda: F.weekday("exit_ts").cast("long"), "extract(isodow FROM exit_ts) - 1"), "side": (lambda: F.col("side"), "side")}
for _b, (_fn, _sqlb) in BUCKETS.items():
    def _bd(spark, sf, fn=_fn, name=_b):
        return rk.breakdown(v.closed_trades(spark, sf), fn(), name).withColumns({"win_rate": rd("win_rate"), "avg_pnl": rd("avg_pnl", 4)})
    query(f"k11_breakdown_{_b}", f"SELECT {_sqlb} AS {_b}, count(*) AS trades, {r('avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END)')} AS win_rate, {r('avg(pnl)', 4)} AS avg_pnl FROM closed_trades GROUP BY 1")(_bd)


@query("k11_w14_streaks", f"""
WITH a AS (SELECT *, CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS w, row_number() OVER ({EX}) AS rn FROM closed_trades), b AS (SELECT *, rn - row_number() OVER (PARTITION BY regime, w ORDER BY rn) AS g FROM a), c AS (SELECT regime, w, g, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT regime, max(n) FILTER (w = 1) AS longest_wins, max(n) FILTER (w = 0) AS longest_losses FROM c GROUP BY 1""")
def _(spark, sf):
    return rk.streaks(v.closed_trades(spark, sf), "regime")


@query("k13_excursions", """
WITH t AS (SELECT DISTINCT regime, entry_ts, exit_ts FROM closed_trades), m AS (SELECT regime AS rg, entry_ts AS et, exit_ts AS xt, min(low) AS low, max(high) AS high FROM t JOIN day_bars b ON b.symbol = regime AND b.ts BETWEEN entry_ts AND exit_ts GROUP BY 1, 2, 3)
SELECT regime, trade_id, leg, entry_ts, exit_ts, low, high FROM closed_trades LEFT JOIN m ON rg = regime AND et = entry_ts AND xt = exit_ts""")
def _(spark, sf):
    return rk.excursions(v.closed_trades(spark, sf), v.day_bars(spark, sf)).select("regime", "trade_id", "leg", "entry_ts", "exit_ts", "low", "high")


@query("k11_excursion_quartiles", f"""
WITH t AS (SELECT DISTINCT regime, entry_ts, exit_ts FROM closed_trades), m AS (SELECT regime AS rg, entry_ts AS et, exit_ts AS xt, min(low) AS low, max(high) AS high FROM t JOIN day_bars b ON b.symbol = regime AND b.ts BETWEEN entry_ts AND exit_ts GROUP BY 1, 2, 3),
e AS (SELECT side, low - open AS down, high - open AS up FROM closed_trades JOIN m ON rg = regime AND et = entry_ts AND xt = exit_ts JOIN (SELECT symbol, ts, open FROM day_bars) d ON d.symbol = regime AND d.ts = entry_ts),
x AS (SELECT 'mae' AS kind, CASE side WHEN 'long' THEN -down ELSE up END AS size FROM e UNION ALL SELECT 'mfe', CASE side WHEN 'long' THEN up ELSE -down END FROM e)
SELECT kind, count(*) AS n, {r("avg(size)", 4)} AS mean, {r("max(size)", 4)} AS largest, {r("quantile_cont(size, 0.25)", 4)} AS p25, {r("quantile_cont(size, 0.5)", 4)} AS p50, {r("quantile_cont(size, 0.75)", 4)} AS p75 FROM x WHERE size > 0 GROUP BY 1""")
def _(spark, sf):
    days = v.day_bars(spark, sf)
    opens = days.select(F.col("symbol").alias("regime"), F.col("ts").alias("entry_ts"), F.col("open").alias("entry_price"))
    t = rk.excursion_statistics(rk.excursions(v.closed_trades(spark, sf), days).join(opens, ["regime", "entry_ts"]))
    return t.select("kind", "n", *[rd(c, 4).alias(c) for c in ("mean", "largest", "p25", "p50", "p75")])


TP = "PARTITION BY symbol ORDER BY ts, seq"


@query("k14_position_roll_up", f"""
WITH a AS (SELECT *, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS q FROM ticks), b AS (SELECT *, sum(q) OVER ({TP}) AS net, sum(-q * price) OVER ({TP}) AS cash FROM a),
c AS (SELECT *, sum(CASE WHEN net = 0 THEN 1 ELSE 0 END) OVER ({TP}) - CASE WHEN net = 0 THEN 1 ELSE 0 END AS trip, coalesce(last_value(CASE WHEN net = 0 THEN cash END IGNORE NULLS) OVER ({TP} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS re FROM b)
SELECT symbol, seq, CAST(net AS BIGINT) AS net, {r("cash", 3)} AS cash, CAST(trip AS BIGINT) AS trip, {r("re", 3)} AS realised, {r("cash + net * price - re", 3)} AS unrealised FROM c""")
def _(spark, sf):
    return rk.roll_up(v.ticks(spark, sf)).select("symbol", "seq", "net", "trip", *[rd(c, 3).alias(c) for c in ("cash", "realised", "unrealised")])


@query("k16_run_comparison", f"""
SELECT a.symbol, count(*) AS n, {r("corr(a.price, b.price)")} AS correlation, {r("avg(CASE WHEN a.side = b.side THEN 1 ELSE 0 END)")} AS match_rate, {r("avg(abs(a.price - b.price))")} AS mean_diff FROM source_a a JOIN source_b b ON a.symbol = b.symbol AND a.ts = b.ts GROUP BY 1""")
def _(spark, sf):
    return rk.compare_runs(v.source_a(spark, sf), v.source_b(spark, sf), ["symbol", "ts"]).withColumns({c: rd(c) for c in ("correlation", "match_rate", "mean_diff")})


PAIRS = [("click", "view"), ("click", "purchase"), ("purchase", "view")]


@query("k17_rolling_correlation", f"""
WITH j AS (SELECT a.symbol AS a, b.symbol AS b, a.ts, a.ret AS ra, b.ret AS rb FROM barx a JOIN barx b ON a.ts = b.ts AND (a.symbol, b.symbol) IN (('click', 'view'), ('click', 'purchase'), ('purchase', 'view')) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)
SELECT a, b, ts, {r("CASE WHEN count(*) OVER w >= 60 THEN corr(ra, rb) OVER w END")} AS correlation FROM j WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return rk.rolling_correlation(v.bars(spark, sf), 60, PAIRS).withColumn("correlation", rd("correlation"))


@query("k18_volatility_forecast", f"""
WITH g AS (SELECT symbol AS s, stddev_samp(ret) AS lr FROM barx GROUP BY 1), a AS (SELECT symbol, ts, {std("ret", 20)} AS c FROM barx)
SELECT symbol, ts, {r("(c + 0.1 * (lr - c)) * sqrt(60 / 1440.0::DOUBLE)")} AS forecast FROM a JOIN g ON symbol = s""")
def _(spark, sf):
    return rk.volatility_forecast(v.bars(spark, sf), 60).select("symbol", "ts", rd("forecast").alias("forecast"))


def rolling_sql(interval: str) -> str:
    """Window metrics; the drawdown from the trades of each window as a list, its running totals and their running highs."""
    return f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY exit_ts, trade_id, leg, quantity, pnl) AS rn FROM closed_trades),
s AS (SELECT *, sum(pnl) OVER (PARTITION BY regime ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cum FROM o),
w AS (SELECT regime, trade_id, leg, exit_ts, rn, pnl, count(*) OVER w AS n, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER w AS win_rate, sum(pnl) OVER w AS total,
 CASE WHEN count(*) OVER w >= 2 THEN avg(pnl) OVER w / nullif(stddev_samp(pnl) OVER w, 0) END AS sharpe, max(rn) OVER w AS hi FROM s
 WINDOW w AS (PARTITION BY regime ORDER BY exit_ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)),
x AS (SELECT w.regime, w.hi, w.n, s.rn, s.cum, max(s.cum) OVER (PARTITION BY w.regime, w.hi ORDER BY s.rn ROWS UNBOUNDED PRECEDING) AS peak
 FROM (SELECT DISTINCT regime, hi, n FROM w) w JOIN s ON s.regime = w.regime AND s.rn BETWEEN w.hi - w.n + 1 AND w.hi),
d AS (SELECT regime, hi, max(peak - cum) AS dd FROM x GROUP BY 1, 2)
SELECT regime, trade_id, leg, exit_ts, {r("pnl", 4)} AS pnl, n, {r("win_rate")} AS win_rate, {r("total", 4)} AS total, {r("sharpe")} AS sharpe, {r("dd", 4)} AS max_drawdown
FROM w JOIN d USING (regime, hi)"""


def rolling(spark, sf, seconds):
    t = rk.rolling_trades(v.closed_trades(spark, sf), "regime", seconds)
    return t.select("regime", "trade_id", "leg", "exit_ts", rd("pnl", 4).alias("pnl"), "n", rd("win_rate").alias("win_rate"), rd("total", 4).alias("total"),
                    rd("sharpe").alias("sharpe"), rd("max_drawdown", 4).alias("max_drawdown"))


@query("k19_rolling_trades", rolling_sql("30 DAYS"))
def _(spark, sf):
    return rolling(spark, sf, 30 * 86400)


@query("k19_rolling_hour", rolling_sql("1 HOUR"))
def _(spark, sf):
    return rolling(spark, sf, 3600)


@query("k19_rolling_day", rolling_sql("1 DAY"))
def _(spark, sf):
    return rolling(spark, sf, 86400)


@query("d16_trailing_stops", f"""
WITH {HELD}, u AS (SELECT *, first_value(open) OVER (PARTITION BY symbol, trade ORDER BY ts) AS entry FROM t WHERE held <> 0), x AS (SELECT *, max(held * (close - entry)) OVER (PARTITION BY symbol, trade ORDER BY ts) AS best FROM u)
SELECT symbol, ts, held, {r("entry")} AS entry, {r("CASE WHEN best >= 10 THEN entry + held * 1.0 ELSE entry * (1 - held * 0.02) END")} AS stop FROM x""")
def _(spark, sf):
    return rk.trailing_stops(signals(spark, sf), 10.0, 1.0).select("symbol", "ts", "held", rd("entry").alias("entry"), rd("stop").alias("stop"))


@query("d20_circuit_breaks", f"""
WITH a AS (SELECT *, CAST(exit_ts AS DATE) AS day, row_number() OVER ({EX}) AS rn, sum(pnl) OVER ({EX} ROWS UNBOUNDED PRECEDING) AS cum,
 CASE WHEN count(*) OVER ({EX} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN max(pnl) OVER ({EX} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) < 0 END AS l5,
 CASE WHEN count(*) OVER ({EX} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= 10 THEN avg(abs(pnl)) OVER ({EX} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS m10 FROM closed_trades),
b AS (SELECT *, max(cum) OVER (PARTITION BY regime ORDER BY rn) AS peak, sum(pnl) OVER (PARTITION BY regime, day ORDER BY rn) AS dl FROM a),
c AS (SELECT *, CASE WHEN dl < -60000 THEN 'daily_loss' WHEN cum - peak < -400000 THEN 'drawdown' WHEN l5 THEN 'consecutive_losses' WHEN m10 > 30000 THEN 'volatility' END AS reason FROM b)
SELECT regime, day, arg_min(reason, rn) AS first_reason, count(*) AS breaches FROM c WHERE reason IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return rk.circuit_breaks(v.closed_trades(spark, sf), "regime", 60000, 400000, 30000)
