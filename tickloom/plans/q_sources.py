"""Scans, sources, sinks and the catalog (S01-S31).  Sinks write below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import schema
from tickloom.operators import dataset as ds, quality as qa, rolling as ro
from tickloom.plans import views as v
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.session import scratch_path
from tickloom.sources import catalog as ct, lake as lk, mixed, published as pb

DAY = "CAST(ts AS DATE)"


@query("s01_parquet_filtered_sample", """
SELECT event_id, event_type, ts FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 300""")
def _(spark, sf):
    v.table(spark, sf, "events")
    return lk.load(spark, [f"{sf}/events.parquet"], ["view", "click"], "2024-01-05", "2024-01-15", 300, "event_type", "ts", "event_id").select(
        "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("s02_pushed_time_bounds", "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, sf):
    v.table(spark, sf, "events")
    return lk.load(spark, [f"{sf}/events.parquet"], start="2024-01-10", end="2024-01-11").select("event_id", "value")


@query("s03_csv_aliases", "SELECT symbol, ts, seq, price, quantity FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    lk.export(v.ticks(spark, sf).select("symbol", F.col("ts").alias("datetime"), "seq", F.col("price").alias("preco"), F.col("quantity").alias("qtd")), path, "csv")
    names = schema._struct(symbol="s", datetime="t", seq="l", preco="d", qtd="l")
    return lk.read_csv(spark, path, names, "2024-01-10", "2024-01-20")


@query("s03_mixed_headers", "SELECT symbol, ts, seq, price, quantity FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, sf):
    root, t = scratch_path(spark, "mixed"), v.ticks(spark, sf)
    lk.export(t.where("seq % 3 = 0").select("symbol", F.col("ts").alias("Date"), "seq", "price", "quantity"), f"{root}/a", "csv")
    lk.export(t.where("seq % 3 = 1").select(F.col("quantity").alias("qty"), F.col("price").alias("preco"), "seq", F.col("ts").alias("datetime"), F.col("symbol").alias("ticker")), f"{root}/b", "csv")
    lk.export(t.where("seq % 3 = 2").select("seq", "side", F.col("ts").alias("time"), "price", "quantity", "symbol"), f"{root}/c", "csv")
    return mixed.read_csv(spark, [root], schema._struct(symbol="s", ts="t", seq="l", price="d", quantity="l"), "2024-01-10", "2024-01-20")


@query("s04_tick_csv", """
SELECT date_trunc('second', ts) AS ts, price, quantity::DOUBLE AS qty, CAST(buy_agent AS VARCHAR) AS buy_agent, CASE side WHEN 'buy' THEN 'AggressorBuyer' WHEN 'sell' THEN 'AggressorSeller' ELSE 'Auction' END AS trade_type FROM ticks""")
def _(spark, sf):
    path = scratch_path(spark, "ticks-csv")
    t = v.ticks(spark, sf)
    kind = F.when(F.col("side") == "buy", "AggressorBuyer").when(F.col("side") == "sell", "AggressorSeller").otherwise("Auction")
    lk.export(t.select(F.date_format("ts", "yyyyMMdd").cast("int").alias("<date>"), F.date_format("ts", "HHmmss").cast("int").alias("<time>"), F.col("price").alias("<price>"),
                       F.col("quantity").alias("<qty>"), (F.col("price") * F.col("quantity")).alias("<vol>"), F.col("buy_agent").alias("<buy_agent>"),
                       F.col("sell_agent").alias("<sell_agent>"), kind.alias("<trade_type>")), path, "csv")
    return lk.read_tick_csv(spark, path).select("ts", "price", "qty", "buy_agent", "trade_type")


@query("s05_json_lines", "SELECT symbol, seq, price, date_trunc('second', ts) AS ts FROM ticks")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    lk.export(v.ticks(spark, sf).select("symbol", "seq", "price", F.unix_seconds("ts").alias("timestamp")), path, "json")
    return lk.read_jsonl(spark, path, schema._struct(symbol="s", seq="l", price="d", timestamp="l")).select("symbol", "seq", "price", "ts")


def _lake(spark, sf):
    root = scratch_path(spark, "lake")
    lk.write_lake(v.ticks(spark, sf), root, "trades", 0.9)
    return root


@query("s06_s07_s08_lake_read", "SELECT symbol, seq, quantity FROM ticks WHERE symbol = 'view' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND extract(isodow FROM ts) <= 5")
def _(spark, sf):
    return lk.read_lake(spark, _lake(spark, sf), "view", "trades", "2024-01-05", "2024-01-15", True, ["symbol", "seq", "quantity"])


@query("s08_quality_gate", "SELECT 0 AS written_bad, 1 AS written_good, count(*) AS rows FROM ticks")
def _(spark, sf):
    t, a, b = v.ticks(spark, sf), scratch_path(spark, "bad"), scratch_path(spark, "good")
    bad, good = lk.write_lake(t, a, "trades", 0.4), lk.write_lake(t, b, "trades", 0.9)
    return spark.read.parquet(b).agg(F.lit(int(bad)).alias("written_bad"), F.lit(int(good)).alias("written_good"), F.count(F.lit(1)).alias("rows"))


@query("s09_consolidate_by_type", "SELECT symbol, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM ticks GROUP BY 1")
def _(spark, sf):
    df = lk.consolidate(v.ticks(spark, sf), scratch_path(spark, "by-type"), "symbol", ["ts", "seq"])
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("s10_consolidate_by_hour", "SELECT extract(hour FROM ts) AS hour, count(*) AS rows FROM ticks GROUP BY 1")
def _(spark, sf):
    df = lk.consolidate(v.ticks(spark, sf).withColumn("hour", F.hour("ts")), scratch_path(spark, "by-hour"), "hour", ["ts", "seq"])
    return df.groupBy(F.col("hour").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("rows"))


@query("s11_incremental_merge", """
SELECT symbol, ts, seq, price FROM (SELECT * FROM source_a UNION ALL SELECT * FROM source_b) QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC, price DESC) = 1""")
def _(spark, sf):
    root = scratch_path(spark, "merge")
    for part in (v.source_a(spark, sf), v.source_b(spark, sf)):
        pb.merge(part.withColumn("date", F.to_date("ts")), root, "date", ["symbol", "ts"], ["seq", "price"])
    return pb.read(spark, root).select("symbol", "ts", "seq", "price")


@query("s12_training_ready", "SELECT DISTINCT symbol, seq, price, extract(hour FROM ts) AS hour, extract(minute FROM ts) AS minute, extract(second FROM ts)::BIGINT AS second FROM dirty_ticks")
def _(spark, sf):
    return lk.training_ready(v.dirty_ticks(spark, sf).drop("copy")).select("symbol", "seq", "price", *[F.col(c).cast("long").alias(c) for c in ("hour", "minute", "second")])


@query("s14_time_travel", """
SELECT symbol, seq, price, date_trunc('milliseconds', ts) AS ts FROM ticks WHERE symbol = 'click' AND date_trunc('milliseconds', ts) >= TIMESTAMP '2024-01-06' AND date_trunc('milliseconds', ts) < TIMESTAMP '2024-01-09' ORDER BY ts, seq LIMIT 100""")
def _(spark, sf):
    t = v.ticks(spark, sf).withColumn("timestamp_ms", F.unix_millis("ts")).drop("ts")
    return lk.time_travel(t, "click", "2024-01-06", "2024-01-09", 100).select("symbol", "seq", "price", "ts")


@query("s16_json_payload", "SELECT symbol, ts, close, volume::DOUBLE AS volume, 2 AS feature_count FROM bars")
def _(spark, sf):
    p = lk.payload(v.bars(spark, sf), ["symbol", "ts"], ["close", "volume"])
    path = scratch_path(spark, "payload")
    lk.export(p, path, "json")
    back = spark.read.schema(p.schema).json(path)
    return lk.unpack(back, ["symbol", "ts", "feature_count"], ["close", "volume"])


def _by_date(spark, sf):
    root = scratch_path(spark, "dates")
    v.ticks(spark, sf).withColumn("date", F.to_date("ts")).repartitionByRange("date", "seq").write.partitionBy("date").parquet(root)
    return root


@query("s17_retention", f"SELECT {DAY} AS date, count(*) AS rows FROM ticks WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")
def _(spark, sf):
    root = scratch_path(spark, "retention")
    lk.write_lake(v.ticks(spark, sf), root, "trades")
    lk.drop_before(spark, root, "2024-01-20")
    return spark.read.parquet(root).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("s19_compaction", f"SELECT {DAY} AS date, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS quantity FROM ticks WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def _(spark, sf):
    df = lk.compact(spark, _by_date(spark, sf), scratch_path(spark, "compact"), "2024-01-10", 200)
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity"))


@query("s20_datasets", """
WITH a AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
SELECT CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split, symbol AS regime, count(*) AS rows FROM a GROUP BY 1, 2""")
def _(spark, sf):
    s = ds.split(ro.layout(v.ticks(spark, sf)), 0.7, 0.15).select("split", F.col("symbol").alias("regime"), "ts", "price")
    return lk.write_datasets(s, scratch_path(spark, "datasets")).groupBy("split", "regime").agg(F.count(F.lit(1)).alias("rows"))


@query("s21_consolidation_metadata", f"SELECT symbol, count(*) AS rows, min(price) AS price_min, max(price) AS price_max, {r('avg(price)')} AS price_mean, {r('stddev_samp(price)')} AS price_std, min(ts) AS first, max(ts) AS last FROM ticks GROUP BY 1")
def _(spark, sf):
    return lk.describe(v.ticks(spark, sf), "symbol", F.col("price")).withColumns({"price_mean": rd("price_mean"), "price_std": rd("price_std")})


@query("s22_trade_export", "SELECT regime, trade_id, leg, side, pnl FROM closed_trades")
def _(spark, sf):
    path = scratch_path(spark, "trades-csv")
    t = v.closed_trades(spark, sf).select("regime", "trade_id", "leg", "side", "pnl")
    lk.export(t, path, "csv")
    return spark.read.csv(path, header=True, schema=t.schema)


@query("s23_two_books", "SELECT k, seq, price, CASE WHEN side = 'bid' THEN 'offer' ELSE 'price' END AS book_type FROM quotes WHERE k = 3 AND ts >= TIMESTAMP '2024-01-15'")
def _(spark, sf):
    a, b = scratch_path(spark, "offer"), scratch_path(spark, "price")
    q = v.quotes(spark, sf)
    q.where("side = 'bid'").write.parquet(a)
    q.where("side = 'ask'").write.parquet(b)
    return lk.read_books(spark, a, b, "k", 3, "2024-01-15").select("k", "seq", "price", "book_type")


@query("s24_trades_or_candles", f"SELECT CASE WHEN side = 'auction' THEN 'candles' ELSE 'trades' END AS kind, {DAY} AS date, count(*) AS rows FROM ticks GROUP BY 1, 2")
def _(spark, sf):
    trades, candles = lk.split_trades_candles(v.ticks(spark, sf).withColumn("side", F.when(F.col("side") != "auction", F.col("side"))))
    return lk.union_all([trades.withColumn("kind", F.lit("trades")), candles.withColumn("kind", F.lit("candles"))]).groupBy("kind", "date").agg(F.count(F.lit(1)).alias("rows"))


@query("s25_daily_lake_dedupe", f"SELECT {DAY} AS date, count(DISTINCT ts) AS rows FROM dirty_ticks GROUP BY 1")
def _(spark, sf):
    root = scratch_path(spark, "daily")
    t = v.dirty_ticks(spark, sf).withColumn("date", F.to_date("ts"))
    pb.merge(t.where("copy = 0"), root, "date", ["ts"], ["seq", "copy"])
    pb.merge(t.where("copy = 1"), root, "date", ["ts"], ["seq", "copy"])
    return pb.read(spark, root).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


WINDOWS = {"daily": ("2024-01-17", "CAST(ts AS DATE) = DATE '2024-01-17'"), "weekly": ("2024-01-19", "CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-19'"),
           "monthly": ("2024-01-31", "CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")}
for _p, (_day, _where) in WINDOWS.items():
    def _win(spark, sf, period=_p, day=_day):
        return lk.consolidation_window(v.ticks(spark, sf), day, period).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last"))
    query(f"s26_{_p}_window", f"SELECT symbol, count(*) AS rows, max(ts) AS last FROM ticks WHERE {_where} GROUP BY 1")(_win)


def _log(spark, sf):
    root = scratch_path(spark, "catalog")
    t = v.ticks(spark, sf)
    ct.register(ct.entries(t.where("seq % 2 = 0"), "trades", 1, 40), root)
    ct.register(ct.entries(t, "trades", 2, 40), root)
    return spark.read.parquet(root)


@query("s27_catalog_current", f"SELECT symbol, {DAY} AS date, count(*) AS records, count(*) * 40 AS size_bytes, 2 AS version FROM ticks GROUP BY 1, 2")
def _(spark, sf):
    return ct.current(_log(spark, sf)).select("symbol", "date", "records", "size_bytes", "version")


@query("s28_available_dates", f"SELECT DISTINCT {DAY} AS date FROM ticks WHERE symbol = 'view' ORDER BY 1")
def _(spark, sf):
    return ct.available_dates(_log(spark, sf), "view", "trades")


@query("s29_catalog_stats", f"""
WITH d AS (SELECT symbol, {DAY} AS date, count(*) AS n FROM ticks GROUP BY 1, 2) SELECT symbol, 'trades' AS data_type, count(*) AS days, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) * 40 AS BIGINT) AS size_bytes, min(date) AS first, max(date) AS last,
 {r("avg(CASE WHEN extract(day FROM date) <= 20 THEN 0.9 END)")} AS quality FROM d GROUP BY 1""")
def _(spark, sf):
    q = v.ticks(spark, sf).select("symbol", F.to_date("ts").alias("date")).distinct().where(F.dayofmonth("date") <= 20).withColumn("score", F.lit(0.9))
    return ct.stats(_log(spark, sf), q).withColumn("quality", rd("quality"))


@query("s30_large_old_partitions", f"""
SELECT symbol, {DAY} AS date, count(*) * 40 AS size_bytes FROM ticks WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2 HAVING count(*) * 40 > 2500 ORDER BY 3 DESC, 1, 2""")
def _(spark, sf):
    return ct.large_old(_log(spark, sf), "2024-01-20", 2500).select("symbol", "date", "size_bytes")


@query("s31_source_info", "SELECT 1::BIGINT AS files, count(*) AS rows, 6 AS columns, min(ts) AS first, max(ts) AS last FROM events")
def _(spark, sf):
    v.table(spark, sf, "events")
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return lk.source_info(df, "ts").drop("bytes")
