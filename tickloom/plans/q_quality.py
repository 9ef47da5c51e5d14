"""Data quality (Q01-Q19) and multi-source merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import dedupe, merge as mg, quality as qa
from tickloom.operators.windows import by_time, pct_change
from tickloom.plans import views as v
from tickloom.plans.q_filters import BROKEN, _broken
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import W, flag, lag

TP = "PARTITION BY symbol ORDER BY ts, seq"
DP = "PARTITION BY symbol ORDER BY ts, seq, copy"

RULES = f"""
WITH q AS (SELECT symbol AS s, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty_ticks GROUP BY 1),
a AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({DP})) / 1e6 AS gap FROM dirty_ticks JOIN q ON symbol = s),
m AS (SELECT symbol, avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END) AS missing, avg(CASE WHEN gap = 0 THEN 1.0 ELSE 0 END) AS duplicates,
 avg(CASE WHEN price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) THEN 1.0 ELSE 0 END) AS outliers, max(gap) / 60 AS max_gap_minutes,
 avg(CASE WHEN extract(isodow FROM ts) <= 5 AND extract(hour FROM ts) * 60 + extract(minute FROM ts) BETWEEN 540 AND 1080 THEN 0 ELSE 1.0 END) AS outside_hours,
 sum(CASE WHEN price <= 0 THEN 1 ELSE 0 END)::DOUBLE AS non_positive FROM a GROUP BY 1),
u AS (UNPIVOT (SELECT symbol, missing::DOUBLE AS missing, duplicates::DOUBLE AS duplicates, outliers::DOUBLE AS outliers, max_gap_minutes::DOUBLE AS max_gap_minutes,
   outside_hours::DOUBLE AS outside_hours, non_positive FROM m) ON missing, duplicates, outliers, max_gap_minutes, outside_hours, non_positive INTO NAME rule VALUE metric),
c AS (SELECT symbol, rule, CASE WHEN rule IN ('duplicates', 'max_gap_minutes', 'non_positive') THEN 'error' ELSE 'warning' END AS severity, metric,
 metric <= CASE rule WHEN 'missing' THEN 0.01 WHEN 'duplicates' THEN 0.001 WHEN 'outliers' THEN 0.001 WHEN 'max_gap_minutes' THEN 120 WHEN 'outside_hours' THEN 0.01 ELSE 0 END AS passed FROM u)
"""


@query("q01_q02_rules", RULES + f"""
SELECT symbol, rule, severity, {r("metric")} AS metric, CAST(passed AS INT) AS passed, CASE WHEN passed THEN 1.0 WHEN severity = 'error' THEN 0.0 ELSE 0.5 END::DOUBLE AS points FROM c""")
def _(spark, sf):
    return qa.check(qa.prepared(v.dirty_ticks(spark, sf), ["seq", "copy"]), ["symbol"], qa.tick_rules()).select(
        "symbol", "rule", "severity", rd("metric").alias("metric"), F.col("passed").cast("int").alias("passed"), "points")


@query("q01_score", RULES + f"""
SELECT symbol, {r("avg(CASE WHEN passed THEN 1.0 WHEN severity = 'error' THEN 0.0 ELSE 0.5 END)")} AS score, CAST(sum(CASE WHEN NOT passed AND severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
 CAST(sum(CASE WHEN NOT passed AND severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings FROM c GROUP BY 1""")
def _(spark, sf):
    c = qa.check(qa.prepared(v.dirty_ticks(spark, sf), ["seq", "copy"]), ["symbol"], qa.tick_rules())
    return qa.score(c, ["symbol"]).withColumn("score", rd("score"))


@query("q02_bar_rules", f"""
WITH a AS (SELECT b.*, abs(open - {lag("close")}) / {lag("close")} AS g FROM {BROKEN} b), m AS (SELECT symbol,
 sum(CASE WHEN high < greatest(open, low, close) THEN 1 ELSE 0 END + CASE WHEN low > least(open, high, close) THEN 1 ELSE 0 END)::DOUBLE AS ohlc, avg(CASE WHEN g > 0.02 THEN 1.0 ELSE 0 END)::DOUBLE AS gaps FROM a GROUP BY 1)
SELECT symbol, 'ohlc' AS rule, {r("ohlc")} AS metric, CAST(ohlc <= 0 AS INT) AS passed FROM m UNION ALL SELECT symbol, 'price_gaps', {r("gaps")}, CAST(gaps <= 0.01 AS INT) FROM m""")
def _(spark, sf):
    rules = [x for x in qa.bar_rules() if x.name != "low_trades"]
    return qa.check(qa.with_price_gap(_broken(spark, sf)), ["symbol"], rules).select(
        "symbol", "rule", rd("metric").alias("metric"), F.col("passed").cast("int").alias("passed"))


@query("q01_auto_fix", f"SELECT symbol, ts, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low FROM {BROKEN} b")
def _(spark, sf):
    return qa.apply_fixes(_broken(spark, sf), qa.bar_rules()).select("symbol", "ts", "high", "low")


@query("q03_fixed_ticks", """
WITH d AS (SELECT symbol, ts, seq, CASE WHEN price > 0 THEN price END AS p FROM dirty_ticks QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC, copy DESC) = 1)
SELECT symbol, ts, seq, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(p IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM d""")
def _(spark, sf):
    return qa.fixed_ticks(v.dirty_ticks(spark, sf), ["seq", "copy"]).select("symbol", "ts", "seq", "price")


@query("q05_partition_score", f"""
WITH t AS (SELECT *, CAST(ts AS DATE) AS day FROM dirty_ticks), q AS (SELECT symbol AS s, day AS d, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM t GROUP BY 1, 2),
m AS (SELECT symbol, day, count(*) AS n, avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END) AS missing, (count(*) - count(DISTINCT ts)) / count(*) AS dup,
 avg(CASE WHEN price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) THEN 1.0 ELSE 0 END) AS outl, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9 AS h FROM t JOIN q ON symbol = s AND day = d GROUP BY 1, 2)
SELECT symbol, day, n, {r("CASE WHEN missing > 0.01 THEN 1 - missing ELSE 1 END * (1 - dup * 2) * CASE WHEN outl > 0.001 THEN 0.9 ELSE 1 END * CASE WHEN n < 100 THEN 0.5 ELSE 1 END * CASE WHEN h < 6 THEN 0.8 ELSE 1 END", 8)} AS score FROM m""")
def _(spark, sf):
    return qa.partition_score(v.dirty_ticks(spark, sf)).select("symbol", "day", "n", rd("score", 8).alias("score"))


@query("q06_partition_continuity", f"""
WITH p AS (SELECT symbol, CAST(ts AS DATE) AS day, min(ts) AS a, max(ts) AS b FROM ticks GROUP BY 1, 2), g AS (SELECT *, (epoch_us(a) - lag(epoch_us(b)) OVER (PARTITION BY symbol ORDER BY day)) / 1e6 AS gap FROM p)
SELECT symbol, day, {r("gap")} AS gap, CASE WHEN gap IS NULL THEN 'start' WHEN gap < 0 THEN 'overlap' WHEN gap > 1800 THEN 'gap' ELSE 'continuous' END AS status FROM g""")
def _(spark, sf):
    return qa.continuity(v.ticks(spark, sf), 1800).select("symbol", "day", rd("gap").alias("gap"), "status")


@query("q07_gap_list", f"""
SELECT symbol, p AS start, ts AS "end", {r("(epoch_us(ts) - epoch_us(p)) / 1e6")} AS gap FROM (SELECT *, lag(ts) OVER ({TP}) AS p FROM ticks) WHERE epoch_us(ts) - epoch_us(p) > 3600000000""")
def _(spark, sf):
    return qa.gap_list(v.ticks(spark, sf), 3600).withColumn("gap", rd("gap"))


@query("q07_continuity_score", f"""
WITH a AS (SELECT symbol, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({TP})) / 1e6 AS g FROM ticks)
SELECT symbol, count(*) AS rows, CAST(sum(CASE WHEN g > 3600 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, {r("max(CASE WHEN g > 3600 THEN g END)")} AS longest, {r("1 - sum(CASE WHEN g > 3600 THEN 1 ELSE 0 END) / count(*)")} AS continuity FROM a GROUP BY 1""")
def _(spark, sf):
    return qa.continuity_score(v.ticks(spark, sf), 3600).withColumns({"longest": rd("longest"), "continuity": rd("continuity")})


@query("q08_regular_grid", f"""
WITH sp AS (SELECT symbol AS s, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), gr AS (SELECT s, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS g FROM sp),
d AS (SELECT s AS symbol, g AS ts, close AS c, CASE WHEN close IS NOT NULL THEN g END AS ct FROM gr LEFT JOIN bars ON symbol = s AND ts = g),
f AS (SELECT *, last_value(c IGNORE NULLS) OVER b AS pv, last_value(ct IGNORE NULLS) OVER b AS pt, first_value(c IGNORE NULLS) OVER n AS nv, first_value(ct IGNORE NULLS) OVER n AS nt FROM d
 WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, CASE WHEN c IS NULL THEN 0 ELSE 1 END AS real, pv AS carried, {r("CASE WHEN c IS NOT NULL THEN c ELSE pv + (nv - pv) * (epoch(ts) - epoch(pt)) / (epoch(nt) - epoch(pt)) END")} AS interpolated FROM f""")
def _(spark, sf):
    return qa.regular_grid(v.bars(spark, sf), 60).withColumn("interpolated", rd("interpolated"))


GAPPY = """(SELECT symbol, ts, trades, CASE WHEN volume % 3 > 0 THEN close END AS close, CASE WHEN volume % 5 > 0 THEN open END AS open, CASE WHEN volume % 4 > 0 THEN volume END AS volume,
 CASE WHEN volume % 7 > 2 THEN high / low END AS hl_ratio, CASE WHEN volume % 2 > 0 THEN 40.0::DOUBLE END AS rsi FROM bars)"""


def _gappy(spark, sf):
    x, w = F.col("volume"), F.when
    return v.bars(spark, sf).select("symbol", "ts", "trades", w(x % 3 > 0, F.col("close")).alias("close"), w(x % 5 > 0, F.col("open")).alias("open"),
                                    w(x % 4 > 0, x).alias("volume"), w(x % 7 > 2, F.col("high") / F.col("low")).alias("hl_ratio"), w(x % 2 > 0, 40.0).alias("rsi"))


LINE = "coalesce({x}, {p} + ({n} - {p}) * (i - {pi}) / ({ni} - {pi}), {p})"
FILLS = """SELECT *, last_value(close IGNORE NULLS) OVER b AS cp, first_value(close IGNORE NULLS) OVER n AS cn, last_value(open IGNORE NULLS) OVER b AS op, first_value(open IGNORE NULLS) OVER n AS onx,
 last_value(CASE WHEN open IS NOT NULL THEN i END IGNORE NULLS) OVER b AS opi, first_value(CASE WHEN open IS NOT NULL THEN i END IGNORE NULLS) OVER n AS oni,
 last_value(hl_ratio IGNORE NULLS) OVER b AS hp, first_value(hl_ratio IGNORE NULLS) OVER n AS hn, last_value(CASE WHEN hl_ratio IS NOT NULL THEN i END IGNORE NULLS) OVER b AS hpi,
 first_value(CASE WHEN hl_ratio IS NOT NULL THEN i END IGNORE NULLS) OVER n AS hni FROM g
 WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("q09_null_strategies", f"""
WITH g AS (SELECT *, row_number() OVER {W} AS i FROM {GAPPY} z), f AS ({FILLS})
SELECT symbol, ts, cp AS close, {r("coalesce(open, op + (onx - op) * (i - opi) / (oni - opi), op)")} AS open, coalesce(volume, 0) AS volume FROM f WHERE hl_ratio IS NOT NULL""")
def _(spark, sf):
    return qa.handle_nulls(_gappy(spark, sf), {"close": "ffill", "open": "interpolate", "volume": "zero", "hl_ratio": "drop"}).select(
        "symbol", "ts", "close", rd("open").alias("open"), "volume")


@query("q09_null_report", f"""
SELECT 'close' AS feature, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls_before, 0::BIGINT AS nulls_after FROM {GAPPY} z
UNION ALL SELECT 'volume', CAST(sum(CASE WHEN volume IS NULL THEN 1 ELSE 0 END) AS BIGINT), 0 FROM {GAPPY} z""")
def _(spark, sf):
    g = _gappy(spark, sf)
    fixed = qa.handle_nulls(qa.handle_nulls(g, {"close": "ffill", "volume": "zero"}), {"close": "bfill"})
    return qa.null_report(g, fixed, ["close", "volume"])


@query("q10_smart_fill", f"""
WITH g AS (SELECT *, row_number() OVER {W} AS i FROM {GAPPY} z), f AS ({FILLS}),
h AS (SELECT *, CASE WHEN hl_ratio IS NOT NULL THEN hl_ratio WHEN i - hpi <= 5 THEN hp + (hn - hp) * (i - hpi) / (hni - hpi) END AS x FROM f)
SELECT symbol, ts, coalesce(cp, cn) AS close, {r("coalesce(volume, 0)")} AS volume, coalesce(rsi, 50) AS rsi,
 {r("coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS hl_ratio FROM h""")
def _(spark, sf):
    return qa.smart_fill(_gappy(spark, sf), ["close", "volume", "rsi", "hl_ratio"]).select(
        "symbol", "ts", "close", rd("volume").alias("volume"), "rsi", rd("hl_ratio").alias("hl_ratio"))


@query("q10_zero_share", f"""
WITH f AS (SELECT symbol, coalesce(volume, 0)::DOUBLE AS volume, coalesce(rsi, 50)::DOUBLE AS rsi FROM {GAPPY} z),
u AS (SELECT symbol, 'volume' AS name, volume AS x FROM f UNION ALL SELECT symbol, 'rsi', rsi FROM f)
SELECT symbol, name, {r("avg(CASE WHEN x = 0 THEN 1 ELSE 0 END)")} AS zeros, {flag("avg(CASE WHEN x = 0 THEN 1 ELSE 0 END) > 0.3")} AS suspicious FROM u GROUP BY 1, 2""")
def _(spark, sf):
    return qa.zero_share(qa.smart_fill(_gappy(spark, sf), ["volume", "rsi"]), ["volume", "rsi"]).withColumn("zeros", rd("zeros"))


@query("q11_synthetic_signs", f"""
WITH a AS (SELECT *, round(price - lag(price) OVER ({TP}), 2) AS d, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({TP})) / 1e6 AS g, lag(price) OVER ({TP}) AS prev FROM ticks),
b AS (SELECT symbol, stddev_samp(quantity) / avg(quantity) AS vc, stddev_samp(g) / avg(g) AS ic, corr(price, prev) AS ac, count(DISTINCT d) / count(d) AS us FROM a GROUP BY 1),
t AS (SELECT symbol AS s, max(c) / sum(c) AS ts FROM (SELECT symbol, quantity, count(*) AS c FROM ticks GROUP BY 1, 2) GROUP BY 1)
SELECT symbol, {r("vc")} AS volume_cv, {r("ic")} AS interval_cv, {r("ac")} AS autocorr, {r("us")} AS unique_steps, {r("ts")} AS top_share,
 concat_ws(',', CASE WHEN vc < 0.15 THEN 'even_volume' END, CASE WHEN us < 0.7 THEN 'repeated_steps' END, CASE WHEN ic < 0.1 THEN 'even_intervals' END, CASE WHEN ts > 0.2 THEN 'dominant_value' END, CASE WHEN abs(ac) > 0.95 THEN 'autocorrelated' END) AS signs FROM b JOIN t ON symbol = s""")
def _(spark, sf):
    return qa.synthetic_signs(v.ticks(spark, sf)).select("symbol", "signs", *[rd(c).alias(c) for c in ("volume_cv", "interval_cv", "autocorr", "unique_steps", "top_share")])


@query("q11_bar_signs", f"""
WITH m AS (SELECT symbol AS s, median(volume) AS med FROM bars GROUP BY 1),
a AS (SELECT bars.*, volume > med AS above, (high - low) / close AS sp FROM bars JOIN m ON symbol = s),
b AS (SELECT *, CASE WHEN above <> lag(above) OVER (PARTITION BY symbol ORDER BY ts) THEN 1 ELSE 0 END AS turn FROM a),
c AS (SELECT symbol, count(*) AS bars, sum(turn) + 1 AS runs, stddev_samp(CASE WHEN sp > 0 THEN sp END) / avg(CASE WHEN sp > 0 THEN sp END) AS cv FROM b GROUP BY 1),
d AS (SELECT *, abs(runs - bars / 2) / (bars / 2) AS o FROM c)
SELECT symbol, bars, CAST(runs AS BIGINT) AS runs, {r("cv")} AS spread_cv, {r("o")} AS runs_off,
 concat_ws(',', CASE WHEN cv < 0.001 THEN 'even_spread' END, CASE WHEN bars > 10 AND o > 0.3 THEN 'volume_runs' END) AS signs FROM d""")
def _(spark, sf):
    return qa.bar_signs(v.bars(spark, sf)).withColumns({"spread_cv": rd("spread_cv"), "runs_off": rd("runs_off")})


@query("q12_constant_runs", f"""
WITH a AS (SELECT *, CASE WHEN side = 'auction' THEN NULL WHEN quantity > 50 THEN 1 ELSE 0 END AS x FROM ticks), b AS (SELECT *, sum(ch) OVER ({TP}) AS run FROM (SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER ({TP}) OR row_number() OVER ({TP}) = 1 THEN 1 ELSE 0 END AS ch FROM a)),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts, seq) AS l FROM b)
SELECT symbol, count(*) AS rows, max(l) AS longest, CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, {flag("max(l) > count(*) * 0.1")} AS suspicious FROM c GROUP BY 1""")
def _(spark, sf):
    return qa.constant_runs(v.ticks(spark, sf), F.when(F.col("side") != "auction", (F.col("quantity") > 50).cast("int")))


FEATS = ["open", "high", "close", "volume"]


def _strong(c):
    return " + ".join(f"CASE WHEN abs(corr({a}, {b})) > 0.9 THEN 1 ELSE 0 END" for a, b in ((c, o) for o in FEATS if o != c))


@query("q13_feature_report", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS nans, 0::BIGINT AS infs, {r(f'var_samp({c})', 3)} AS variance, {flag(f'max({c}) = min({c})')} AS constant, {_strong(c)} AS duplicates FROM bars" for c in FEATS))
def _(spark, sf):
    return qa.feature_report(v.bars(spark, sf), FEATS, 0.9).withColumn("variance", rd("variance", 3))


@query("q14_container_score", f"""
WITH g AS (SELECT symbol, CASE WHEN epoch(ts) - epoch({lag("ts")}) > 3600 THEN 1 ELSE 0 END AS gp, CASE WHEN buy_trades > 0 THEN 0 ELSE 1 END AS lo FROM bars),
s AS (SELECT symbol, CAST(sum(gp) AS BIGINT) AS gaps, CAST(sum(lo) AS BIGINT) AS lone FROM g GROUP BY 1)
SELECT symbol, gaps, 0::BIGINT AS bad_ohlc, 0::BIGINT AS nulls, lone, 100 - 10 * (CAST(gaps > 0 AS INT) + CAST(lone > 0 AS INT)) AS score FROM s""")
def _(spark, sf):
    b = v.bars(spark, sf)
    return qa.container_score(b, b.where("buy_trades > 0"), 60)


@query("q15_file_integrity", """
SELECT 'events.parquet' AS file, count(*) AS rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(CASE WHEN value <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad, 'ok' AS status FROM events""")
def _(spark, sf):
    v.table(spark, sf, "events")
    return qa.file_integrity(spark.read.parquet(f"{sf}/events.parquet"), "value")


@query("q16_counter_check", f"""
WITH a AS (SELECT *, sum(quantity) OVER ({TP}) AS c FROM ticks), b AS (SELECT *, CASE WHEN seq % 97 = 0 THEN c - 100 ELSE c END AS total FROM a), d AS (SELECT *, total - lag(total) OVER ({TP}) AS st FROM b)
SELECT symbol, count(st) AS steps, CAST(sum(CASE WHEN st < 0 THEN 1 ELSE 0 END) AS BIGINT) AS backward, CAST(sum(CASE WHEN st <> quantity THEN 1 ELSE 0 END) AS BIGINT) AS mismatched FROM d GROUP BY 1""")
def _(spark, sf):
    from tickloom.operators import rolling as ro
    o = ro.layout(v.ticks(spark, sf))
    t = o.running(o.chunked(), c=("sum", F.col("quantity"))).select(
        "symbol", "ts", "seq", "quantity", F.when(F.col("seq") % 97 == 0, F.col("c") - 100).otherwise(F.col("c")).alias("total"))
    return qa.counter_check(t, "total", "quantity")


@query("q17_clip_outliers", f"""
WITH q AS (SELECT symbol AS s, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ticks GROUP BY 1)
SELECT symbol, seq, {r("greatest(least(price, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1))")} AS price_clipped FROM ticks JOIN q ON symbol = s""")
def _(spark, sf):
    return qa.clip_outliers(v.ticks(spark, sf), ["symbol"], "price", 0.5).select("symbol", "seq", rd("price_clipped").alias("price_clipped"))


@query("q17_clip_by_deviation", f"""
WITH q AS (SELECT symbol AS s, avg(price) AS m, stddev_samp(price) AS d FROM ticks GROUP BY 1)
SELECT symbol, seq, {r("greatest(least(price, m + 1.5 * d), m - 1.5 * d)")} AS price_clipped FROM ticks JOIN q ON symbol = s""")
def _(spark, sf):
    return qa.clip_outliers(v.ticks(spark, sf), ["symbol"], "price", 1.5, "z").select("symbol", "seq", rd("price_clipped").alias("price_clipped"))


@query("q18_diagnostics", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'1 - count({c}) / count(*)')} AS null_share, {r(f'var_samp({c})', 3)} AS variance, {r(f'avg(abs({c} - m{i}) / s{i})')} AS mean_abs_z, {r(f'corr({c}, ret)')} AS target_corr FROM barx, (SELECT avg({c}) AS m{i}, stddev_samp({c}) AS s{i} FROM barx)"
    for i, c in enumerate(FEATS)))
def _(spark, sf):
    b = v.bars(spark, sf)
    return qa.diagnostics(b.withColumn("ret", pct_change(F.col("close"), by_time("symbol"))), FEATS, "ret").withColumns(
        {"null_share": rd("null_share"), "variance": rd("variance", 3), "mean_abs_z": rd("mean_abs_z"), "target_corr": rd("target_corr")})


@query("q19_required_features", f"""
SELECT 'close' AS feature, 1 AS present, CAST(sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, 0 AS usable FROM {GAPPY} z UNION ALL SELECT 'trades', 1, 0, 1 UNION ALL SELECT 'vwap_9', 0, NULL, 0""")
def _(spark, sf):
    return qa.required_features(_gappy(spark, sf), ["close", "trades", "vwap_9"]).withColumn("usable", F.coalesce("usable", F.lit(0)))


def _sources(spark, sf):
    return [mg.Source("a", v.source_a(spark, sf), 0.95, 1), mg.Source("b", v.source_b(spark, sf), 0.80, 2)]


STACK = """
WITH s AS (SELECT symbol, ts, seq, price, quantity, 'a' AS src, 0.95::DOUBLE AS q, 1 AS pr FROM source_a UNION ALL SELECT symbol, ts, seq, price, quantity, 'b', 0.80, 2 FROM source_b),
b AS (SELECT *, first_value(price) OVER w AS bp, first_value(quantity) OVER w AS bq, first_value(src) OVER w AS bs FROM s WINDOW w AS (PARTITION BY symbol, ts ORDER BY pr, q DESC, seq)),
c AS (SELECT *, abs(bp - price) / bp AS dp, abs(bp - price) / bp > {tol} OR abs(bq - quantity) / bq > 0.01 AS cf FROM b)
"""
TIGHT = STACK.replace("{tol}", "0.0001")
CASES = {"quality": ("arg_max(price, (q, -pr, -seq))", "arg_max(quantity, (q, -pr, -seq))"), "average": ("avg(price)", "avg(quantity)"),
         "priority": ("arg_min(price, (pr, -q, seq))", "arg_min(quantity, (pr, -q, seq))"), "latest": ("arg_max(price, (pr, q, seq))", "arg_max(quantity, (pr, q, seq))")}
for _mode, (_p, _q) in CASES.items():
    def _merged(spark, sf, mode=_mode):
        return mg.merge_trades(_sources(spark, sf), mode, price_tol=0.0001).withColumns({"price": rd("price", 8), "quantity": rd("quantity")})
    query(f"g01_merge_{_mode}", TIGHT + f"""
SELECT symbol, ts, {r(f"CASE WHEN bool_or(cf) THEN {_p} ELSE arg_min(price, (pr, -q, seq)) END", 8)} AS price, {r(f"CASE WHEN bool_or(cf) THEN {_q} ELSE arg_min(quantity, (pr, -q, seq)) END")} AS quantity, CAST(bool_or(cf) AS INT) AS conflict FROM c GROUP BY 1, 2""")(_merged)


@query("g01_merge_within_tolerance", STACK.replace("{tol}", "0.001") + f"""
SELECT symbol, ts, {r("arg_min(price, (pr, -q, seq))", 8)} AS price, CAST(bool_or(cf) AS INT) AS conflict FROM c GROUP BY 1, 2""")
def _(spark, sf):
    return mg.merge_trades(_sources(spark, sf)).select("symbol", "ts", rd("price", 8).alias("price"), "conflict")


@query("g02_conflict_report", TIGHT + f"""
SELECT symbol, ts, bs AS source1, bp AS value1, src AS source2, price AS value2, {r("dp * 100")} AS diff_pct FROM c WHERE cf""")
def _(spark, sf):
    return mg.conflict_report(_sources(spark, sf), price_tol=0.0001).withColumn("diff_pct", rd("diff_pct"))


@query("g03_g04_first_source", """
SELECT symbol, ts, seq, price, src AS origin FROM (SELECT *, 'a' AS src FROM source_a UNION ALL SELECT *, 'b' FROM source_b)
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src, seq) = 1""")
def _(spark, sf):
    return mg.first_source(_sources(spark, sf), ["symbol", "ts"]).select("symbol", "ts", "seq", "price", F.col("_source").alias("origin"))


def _bars_of(t):
    from tickloom.operators.bars import time_bars
    return time_bars(t, "1 hour").select("symbol", "ts", "open", "high", "low", "close", "volume")


def _bar_sources(spark, sf):
    return [mg.Source("a", _bars_of(v.source_a(spark, sf)), 0.95, 1), mg.Source("b", _bars_of(v.source_b(spark, sf)), 0.80, 2)]


BARS2 = """
WITH x AS (SELECT *, 0.95::DOUBLE AS q, 1 AS pr FROM source_a UNION ALL SELECT *, 0.80, 2 FROM source_b),
k AS (SELECT symbol, date_trunc('hour', ts) AS ts, q, pr, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(quantity) AS volume FROM x GROUP BY symbol, date_trunc('hour', ts), q, pr)
"""


@query("a13_weighted_candles", BARS2 + "SELECT symbol, ts, " + ", ".join(
    f"{r(f'sum({c} * q) / sum(q)')} AS {c}" for c in ("open", "high", "low", "close")) + ", CAST(sum(volume) AS BIGINT) AS volume FROM k GROUP BY 1, 2")
def _(spark, sf):
    return mg.merge_candles(_bar_sources(spark, sf)).withColumns({c: rd(c) for c in ("open", "high", "low", "close")})


@query("a14_g05_priority_candles", BARS2 + """
SELECT symbol, ts, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, CAST(volume AS BIGINT) AS volume FROM k QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY pr, q DESC) = 1""")
def _(spark, sf):
    return mg.tidy_candles(mg.merge_candles(_bar_sources(spark, sf), weighted=False))


@query("g05_tidy_trades", "SELECT symbol, seq, quantity - 5 AS quantity FROM ticks WHERE quantity - 5 > 0")
def _(spark, sf):
    return mg.tidy_trades(v.ticks(spark, sf).withColumn("quantity", F.col("quantity") - 5)).select("symbol", "seq", "quantity")


@query("g06_fingerprints", "SELECT seq, md5(concat_ws('_', epoch_us(ts), printf('%.2f', price), quantity)) AS fingerprint, substring(md5(concat_ws('_', epoch_us(ts), printf('%.2f', price), quantity)), 1, 8) AS short FROM ticks")
def _(spark, sf):
    f = dedupe.fingerprint()
    return v.ticks(spark, sf).select("seq", f.alias("fingerprint"), F.substring(f, 1, 8).alias("short"))
