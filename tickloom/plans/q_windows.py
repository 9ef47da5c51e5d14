"""Ordered windows (W01-W25), sorting and set operations (L, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import dedupe, rolling as ro, scan
from tickloom.operators.ordered import HELPERS
from tickloom.operators.windows import by_time
from tickloom.plans import emasql
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r

W = "(PARTITION BY symbol ORDER BY ts, seq)"


def frame(n, end="CURRENT ROW"):
    return f"(PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN {n} PRECEDING AND {end})"


def full(n, e):
    return f"CASE WHEN count(*) OVER w >= {n} THEN {e} END"


@query("w01_w05_rolling_stats", f"""
SELECT symbol, seq, {r(full(20, "avg(price) OVER w"))} AS mean, {r(full(20, "stddev_samp(price) OVER w"))} AS std,
 {full(20, "min(price) OVER w")} AS min, {full(20, "max(price) OVER w")} AS max, {r(full(20, "sum(price) OVER w"))} AS sum,
 {r(full(20, "quantile_cont(price, 0.5) OVER w"))} AS median, {r(full(20, "corr(price, quantity) OVER w"))} AS corr,
 {r(full(20, "var_pop(price) OVER w"))} AS turbulence,
 {r(full(20, "(len(list_filter(l, lambda x: x < price)) + (len(list_filter(l, lambda x: x = price)) + 1) / 2.0) / len(l)"))} AS rank
FROM (SELECT *, list(price) OVER {frame(19)} AS l FROM ticks) WINDOW w AS {frame(19)}""")
def _(spark, sf):
    return ro.rolling_stats(v.ticks(spark, sf), 20).withColumns(
        {c: rd(c) for c in ("mean", "std", "sum", "median", "rank", "corr", "turbulence")})


@query("w06_w18_rolling_agents", f"""
WITH a AS (SELECT symbol, seq, list(buy_agent) OVER {frame(29)} AS b30, list(sell_agent) OVER {frame(29)} AS s30,
  list(buy_agent) OVER p AS b, count(*) OVER p AS n, sum(quantity::DOUBLE * quantity) OVER p AS qq, sum(quantity) OVER p AS q,
  stddev_samp(quantity) OVER p AS sd, avg(quantity) OVER p AS av
  FROM ticks WINDOW p AS {frame(30, "1 PRECEDING")})
SELECT symbol, seq, len(list_distinct(b30)) AS buyers, len(list_distinct(s30)) AS sellers,
 CASE WHEN n >= 30 THEN {r("list_sum([pow(len(list_filter(b, lambda x: x = u)) / 30, 2) FOR u IN list_distinct(b)])")} END AS buyer_hhi,
 CASE WHEN n >= 30 THEN {r("list_max([len(list_filter(b, lambda x: x = u)) / 30 FOR u IN list_distinct(b)])")} END AS top_buyer_share,
 CASE WHEN n >= 30 THEN {r("qq / (q * q)")} END AS volume_hhi, CASE WHEN n >= 30 THEN {r("sd / av")} END AS volume_cv
FROM a""")
def _(spark, sf):
    return ro.rolling_agents(v.ticks(spark, sf), 30).withColumns(
        {c: rd(c) for c in ("buyer_hhi", "top_buyer_share", "volume_hhi", "volume_cv")})


@query("w02_w03_long_window", f"""
SELECT symbol, seq, {r(full(1000, "quantile_cont(price, 0.5) OVER w"))} AS median,
 {r(full(1000, "(len(list_filter(l, lambda x: x < price)) + (len(list_filter(l, lambda x: x = price)) + 1) / 2.0) / len(l)"))} AS rank
FROM (SELECT *, list(price) OVER {frame(999)} AS l FROM ticks) WINDOW w AS {frame(999)}""")
def _(spark, sf):
    o = ro.layout(v.ticks(spark, sf))
    rows = o.chunked(before=999).select("symbol", "seq", "price", *HELPERS)
    return ro.order_stats(o, rows, "price", 1000).select("symbol", "seq", rd("median").alias("median"), rd("rank").alias("rank"))


@query("w07_time_range_sums", """
SELECT symbol, seq, CAST(sum(quantity) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS volume_3600s,
 CAST(sum(quantity) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECONDS PRECEDING AND CURRENT ROW) AS BIGINT) AS volume_21600s
FROM ticks""")
def _(spark, sf):
    return ro.range_sums(v.ticks(spark, sf), [3600, 21600])


@query("w08_shifts", "SELECT symbol, seq, " + ", ".join(
    f"lag(price, {k}) OVER w AS lag_{k}, lead(price, {k}) OVER w AS lead_{k}, "
    f"{r(f'price - lag(price, {k}) OVER w')} AS diff_{k}, {r(f'price / lag(price, {k}) OVER w - 1')} AS ret_{k}"
    for k in (1, 5)) + f" FROM ticks WINDOW w AS {W}")
def _(spark, sf):
    return ro.shifts(v.ticks(spark, sf), [1, 5]).withColumns(
        {f"{c}_{k}": rd(f"{c}_{k}") for c in ("diff", "ret") for k in (1, 5)})


@query("w09_w11_cumulative", f"""
WITH a AS (SELECT *, price - lag(price) OVER w AS d FROM ticks WINDOW w AS {W})
SELECT symbol, seq, CAST(sum(CASE side WHEN 'buy' THEN quantity WHEN 'sell' THEN -quantity ELSE 0 END) OVER w AS BIGINT) AS cvd,
 CAST(sum(CASE WHEN d > 0 THEN quantity WHEN d < 0 THEN -quantity ELSE 0 END) OVER w AS BIGINT) AS obv,
 {r("sum(price * quantity) OVER w / sum(quantity) OVER w")} AS vwap,
 {r("(price - max(price) OVER w) / max(price) OVER w")} AS drawdown
FROM a WINDOW w AS {W}""")
def _(spark, sf):
    return ro.cumulative(v.ticks(spark, sf)).withColumns({"vwap": rd("vwap"), "drawdown": rd("drawdown")})


@query("w12_position_in_bucket", """
SELECT symbol, seq, row_number() OVER (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts, seq) - 1 AS position FROM ticks""")
def _(spark, sf):
    return ro.bucket_position(v.ticks(spark, sf), F.date_trunc("day", "ts"))


RUNS = f"""
WITH a AS (SELECT *, side IS DISTINCT FROM lag(side) OVER {W} AS ch, row_number() OVER {W} AS rn FROM ticks),
b AS (SELECT *, sum(CASE WHEN ch OR rn = 1 THEN 1 ELSE 0 END) OVER {W} AS run FROM a),
s AS (SELECT symbol, seq, side AS value, CAST(run AS BIGINT) AS run,
  row_number() OVER (PARTITION BY symbol, run ORDER BY ts, seq) AS length FROM b)
"""


@query("w13_streaks", RUNS + "SELECT symbol, seq, value, run, length FROM s")
def _(spark, sf):
    return ro.streaks(v.ticks(spark, sf), F.col("side")).select("symbol", "seq", "value", "run", "length")


@query("w14_longest_runs", RUNS + """
SELECT symbol, value, max(length) AS longest, count(DISTINCT run) AS runs FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return ro.longest_runs(v.ticks(spark, sf), F.col("side"))


@query("w15_centred_extremes", """
SELECT symbol, seq, CASE WHEN count(*) OVER w = 11 AND price = max(price) OVER w THEN 1 ELSE 0 END AS swing_high,
 CASE WHEN count(*) OVER w = 11 AND price = min(price) OVER w THEN 1 ELSE 0 END AS swing_low
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def _(spark, sf):
    return ro.centred_extremes(v.ticks(spark, sf), 5)


@query("w16_w17_fill_and_interpolate", f"""
WITH h AS (SELECT symbol, ts, seq, CASE WHEN quantity % 4 = 0 THEN NULL ELSE price END AS x FROM ticks),
n AS (SELECT *, row_number() OVER {W} AS i FROM h),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
 last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
 first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
 first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM n)
SELECT symbol, seq, pv AS ffill, nv AS bfill, CASE WHEN i - pi <= 1 THEN pv END AS ffill_limit,
 {r("CASE WHEN x IS NOT NULL THEN x WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END")} AS linear FROM f""")
def _(spark, sf):
    t = v.ticks(spark, sf).withColumn("x", F.when(F.col("quantity") % 4 != 0, F.col("price")))
    return ro.filled(t, "x", 1).withColumn("linear", rd("linear"))


@query("w19_ema_ticks", f"""
SELECT symbol, seq, {r(emasql.ema("price", 20, over=W))} AS ema_20
FROM (SELECT *, row_number() OVER {W} AS rn FROM ticks)""")
def _(spark, sf):
    o = ro.layout(v.ticks(spark, sf))
    return scan.ema_ticks(o, F.col("price"), 20, ["symbol", "seq"]).withColumn("ema_20", rd("ema_20"))


@query("w20_w21_smoothing", f"""
WITH a AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars),
s AS (SELECT *, avg(CASE WHEN rn <= 14 THEN close END) OVER (PARTITION BY symbol) AS seed FROM a)
SELECT symbol, ts, {r(emasql.ema("close", 9))} AS ema_9,
 {r(f"CASE WHEN rn >= 12 THEN {emasql.ema_adjusted('close', 12)} END")} AS ema_adj_12,
 {r(emasql.wilder("close", 14, "rn", "seed"))} AS wilder_14 FROM s""")
def _(spark, sf):
    b = v.bars(spark, sf).select("symbol", "ts", "close")
    return scan.smooth(b, ["symbol"], "ts", [
        ("ema_9", "close", "ema", 9), ("ema_adj_12", "close", "ema_adjust", 12),
        ("wilder_14", "close", "wilder", 14)]).select(
        "symbol", "ts", *[rd(c).alias(c) for c in ("ema_9", "ema_adj_12", "wilder_14")])


@query("w22_w23_randomness", f"""
WITH m AS (SELECT symbol AS s, median(price) AS med FROM ticks GROUP BY 1),
a AS (SELECT *, price > med AS ab FROM ticks JOIN m ON symbol = s),
b AS (SELECT *, CASE WHEN ab <> lag(ab) OVER {W} THEN 1 ELSE 0 END AS turn, lag(price) OVER {W} AS prev FROM a)
SELECT symbol, CAST(sum(turn) + 1 AS BIGINT) AS runs, {r("corr(price, prev)")} AS autocorr FROM b GROUP BY 1""")
def _(spark, sf):
    return ro.randomness(v.ticks(spark, sf)).withColumn("autocorr", rd("autocorr"))


@query("w24_rank_within", """
SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY price DESC, seq) AS rank
FROM ticks QUALIFY rank <= 10""")
def _(spark, sf):
    return ro.rank_within(v.ticks(spark, sf), ["symbol"], "price", 10).select("symbol", "seq", "price", "rank")


@query("w25_crossings", f"""
WITH a AS (SELECT symbol, ts, seq, round(CASE WHEN count(*) OVER {frame(19)} >= 20 THEN avg(price) OVER {frame(4)} - avg(price) OVER {frame(19)} END, 9) AS s FROM ticks)
SELECT symbol, seq, CASE WHEN s > 0 AND lag(s) OVER {W} <= 0 THEN 1 WHEN s < 0 AND lag(s) OVER {W} >= 0 THEN -1 ELSE 0 END AS "cross" FROM a""")
def _(spark, sf):
    return ro.crossings(v.ticks(spark, sf), 5, 20)


@query("l01_sorted_rows", "SELECT symbol, ts, seq, price FROM ticks ORDER BY symbol, ts, seq")
def _(spark, sf):
    return v.ticks(spark, sf).select("symbol", "ts", "seq", "price").orderBy("symbol", "ts", "seq")


@query("l02_s15_latest_per_key", """
SELECT symbol, ts, seq, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) <= 100""")
def _(spark, sf):
    return dedupe.latest(v.ticks(spark, sf), ["symbol"], ["ts", "seq"], 100).select("symbol", "ts", "seq", "price")


@query("l03_top_k", "SELECT symbol, seq, quantity FROM ticks ORDER BY quantity DESC, seq LIMIT 50")
def _(spark, sf):
    return v.ticks(spark, sf).select("symbol", "seq", "quantity").orderBy(F.desc("quantity"), "seq").limit(50)


@query("x01_union_all", """
SELECT seq, price, 'a' AS origin FROM source_a UNION ALL SELECT seq, price, 'b' AS origin FROM source_b""")
def _(spark, sf):
    a = v.source_a(spark, sf).select("seq", "price", F.lit("a").alias("origin"))
    return a.unionByName(v.source_b(spark, sf).select("seq", "price", F.lit("b").alias("origin")))


@query("x02_distinct_rows", "SELECT DISTINCT symbol, ts, seq, price, quantity, side FROM dirty_ticks")
def _(spark, sf):
    return v.dirty_ticks(spark, sf).select("symbol", "ts", "seq", "price", "quantity", "side").dropDuplicates()


@query("x03_dedupe_keep_last", """
SELECT symbol, ts, seq, price, copy FROM dirty_ticks
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC, copy DESC) = 1""")
def _(spark, sf):
    return dedupe.keep(v.dirty_ticks(spark, sf), ["symbol", "ts"], ["seq", "copy"], last=True).select(
        "symbol", "ts", "seq", "price", "copy")


@query("x03_dedupe_keep_first", """
SELECT symbol, ts, seq, price, copy FROM dirty_ticks
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq, copy) = 1""")
def _(spark, sf):
    return dedupe.keep(v.dirty_ticks(spark, sf), ["symbol", "ts"], ["seq", "copy"], last=False).select(
        "symbol", "ts", "seq", "price", "copy")


@query("x04_intersect_keys", "SELECT symbol, ts FROM source_a INTERSECT SELECT symbol, ts FROM source_b")
def _(spark, sf):
    return v.source_a(spark, sf).select("symbol", "ts").intersect(v.source_b(spark, sf).select("symbol", "ts"))


@query("x05_except_fingerprints", """
SELECT substring(md5(concat_ws('_', epoch_us(ts), printf('%.2f', price), quantity)), 1, 32) AS fingerprint FROM ticks
EXCEPT SELECT md5(concat_ws('_', epoch_us(ts), printf('%.2f', price), quantity)) FROM source_a""")
def _(spark, sf):
    f = dedupe.fingerprint().alias("fingerprint")
    return v.ticks(spark, sf).select(f).distinct().join(v.source_a(spark, sf).select(f).distinct(), "fingerprint", "left_anti")
