"""Structured Streaming jobs: candles, order flow, running state, joins, refresh, replay.

Every job takes a streaming DataFrame; ``drain`` runs it over what is available and returns the
sink's table, which is how tests and registered queries compare a stream with its batch form.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import bars as bar_ops
from tickloom.operators.dedupe import latest
from tickloom.operators.ordered import lay_out
from tickloom.session import scratch_path
from tickloom.sources import published

LATE = "5 minutes"
#: Seconds for which superseded versions of a stream's table stay readable.
GRACE = 3600.0
#: Rows of a file of replayed history.
SLICE_ROWS = 500_000


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """File stream; ``files_per_batch`` limits the rate (replay, back-pressure)."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def start(df: DataFrame, out: str, checkpoint: str, mode: str = "append", parts: list[str] | None = None,
          every: str | None = None) -> StreamingQuery:
    """Start a stream into Parquet; ``every`` sets the flush interval, otherwise available data only."""
    w = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    if parts:
        w = w.partitionBy(*parts)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def drain(df: DataFrame, mode: str = "append", parts: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    out = scratch_path(spark, "stream")
    start(df, out, scratch_path(spark, "stream-log"), mode, parts).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_each(df: DataFrame, step: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch_path(df.sparkSession, "stream-log"))
         .foreachBatch(step).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def candles(ticks: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """Candles that are emitted once the watermark passes their end."""
    return bar_ops.time_bars(ticks.withWatermark("ts", late), width)


def all_candles(ticks: DataFrame, width: str, late: str = LATE, out: str | None = None, log: str | None = None, grace: float = GRACE) -> DataFrame:
    """Candles including the open one: each batch upserts the candles it changed, day by day, into a published
    table; the watermark lets state forget old ones.  ``out`` and ``log`` are where a restarted stream goes on."""
    spark = ticks.sparkSession
    out = out or scratch_path(spark, "candles")
    agg = bar_ops.time_bars(ticks.withWatermark("ts", late), width)
    drain_each(agg, lambda b, i: _upsert(b, i, out, grace), "update", log)
    return published.read(spark, out).drop("batch", "date")


def _upsert(batch: DataFrame, i: int, out: str, grace: float) -> None:
    """Rows of later batches take the place of earlier ones with the same symbol and time; a repeated batch changes nothing."""
    done = published.last_tag(batch.sparkSession, out)
    if done is None or done < i:
        rows = batch.withColumns({"batch": F.lit(i).cast("long"), "date": F.to_date("ts")})
        published.merge(rows, out, "date", ["symbol", "ts"], ["batch"], tag=i)
        published.vacuum(batch.sparkSession, out, grace=grace)


def _keep(batch: DataFrame, i: int, out: str, rows: Callable[[], DataFrame], grace: float) -> None:
    """Publish ``rows`` as the whole state after batch i, unless that was done before."""
    done = published.last_tag(batch.sparkSession, out)
    if done is None or done < i:
        published.publish(rows(), out, tag=i)
        published.vacuum(batch.sparkSession, out, grace=grace)


def split_late(batch: DataFrame, seconds: int, order: list[str], seen: int | None = None) -> tuple[DataFrame, int | None]:
    """Live rows older than ``seconds`` before the newest row so far are rejected; history is kept.

    ``seen`` is the newest time (microseconds) of earlier batches; the second result is that of all up to this one.
    Rows are judged in order of arrival (``order``) inside a batch, so the split does not depend on how rows are batched.
    """
    parts = batch.withColumn("_us", F.unix_micros("ts"))
    o = lay_out(parts, [], order)
    rows = o.running(o.chunked(), _now=("max", F.col("_us")))
    age = (F.greatest(F.col("_now"), F.lit(seen).cast("long")) - F.col("_us")) / 1e6
    newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
    split = rows.withColumn("rejected", (F.col("live") & (age > seconds)).cast("int")).select(*batch.columns, "rejected")
    return split, max((x for x in (seen, newest) if x is not None), default=None)


def late_split(ticks: DataFrame, seconds: int, order: list[str]) -> DataFrame:
    """Rows with ``rejected``; the newest time so far is kept beside each batch, so a restarted stream goes on from it."""
    spark = ticks.sparkSession
    out, clock = scratch_path(spark, "late"), scratch_path(spark, "late-clock")

    def step(batch: DataFrame, i: int) -> None:
        seen = spark.read.parquet(clock).where(F.col("batch") == i - 1).select("newest").first()[0] if i else None
        rows, newest = split_late(batch, seconds, order, seen)
        rows.write.mode("overwrite").partitionBy("rejected").parquet(f"{out}/batch={i}")
        spark.range(1).select(F.lit(newest).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{clock}/batch={i}")

    drain_each(ticks, step)
    return spark.read.parquet(out)


def sliding_ofi(ticks: DataFrame, width: str, slide: str, late: str = LATE) -> DataFrame:
    q = F.col("quantity")
    side = lambda s: F.sum(F.when(F.col("side") == s, q).otherwise(0))
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(
        side("buy").alias("buy"), side("sell").alias("sell"))
    return g.select("symbol", F.col("w.start").alias("ts"), F.coalesce(F.try_divide(
        (F.col("buy") - F.col("sell")).cast("double"), (F.col("buy") + F.col("sell")).cast("double")), F.lit(0.0)).alias("ofi"))


def running_state(ticks: DataFrame, out: str | None = None, log: str | None = None, grace: float = GRACE) -> DataFrame:
    """Cumulative delta and latest values per key, as a running aggregate (map-side partials, so a
    hot key costs a few rows per task)."""
    spark = ticks.sparkSession
    out = out or scratch_path(spark, "state")
    q, at = F.col("quantity"), F.struct("ts", "seq")
    agg = ticks.groupBy("symbol").agg(
        F.sum(F.when(F.col("side") == "buy", q).when(F.col("side") == "sell", -q).otherwise(0)).alias("cvd"),
        F.count(F.lit(1)).alias("trades"), F.max_by("price", at).alias("last_price"), F.max("ts").alias("last_ts"))
    drain_each(agg, lambda b, i: _keep(b, i, out, lambda: b, grace), "complete", log)
    return published.read(spark, out)


def ring_buffer(ticks: DataFrame, n: int, out: str | None = None, log: str | None = None, grace: float = GRACE) -> DataFrame:
    """The last n rows per key: each batch keeps its own last n, joins the kept rows, trims again."""
    spark = ticks.sparkSession
    out = out or scratch_path(spark, "ring")

    def step(batch: DataFrame, i: int) -> None:
        def rows() -> DataFrame:
            own = latest(batch, ["symbol"], ["ts", "seq"], n)
            if published.last_tag(spark, out) is None:
                return own
            return latest(own.unionByName(published.read(batch.sparkSession, out)), ["symbol"], ["ts", "seq"], n)

        _keep(batch, i, out, rows, grace)

    drain_each(ticks, step, checkpoint=log)
    return published.read(spark, out)


def coordinated(signals: DataFrame, width: str, minimum: int, late: str = LATE) -> DataFrame:
    g = signals.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("action") == "buy").cast("int")).alias("buys"), F.avg("confidence").alias("confidence"))
    return g.where(F.col("n") >= minimum).select(F.col("w.start").alias("ts"), "n", "buys", "confidence")


def decisions_with_fills(decisions: DataFrame, fills: DataFrame, within: str) -> DataFrame:
    """Stream-stream join; the time bound lets both sides forget old rows."""
    d = decisions.withWatermark("decided", "1 day").alias("d")
    f = fills.withWatermark("filled", "1 day").alias("f")
    on = F.expr(f"d.id = f.order_id AND f.filled >= d.decided AND f.filled <= d.decided + INTERVAL {within}")
    return d.join(f, on).select("d.id", "d.decided", "f.filled", "f.quantity", "f.price")


def refresh_features(ticks: DataFrame, width: str, look_back: int, feature: Callable[[DataFrame], DataFrame], grace: float = GRACE) -> DataFrame:
    """Per batch: rebuild the touched bars, read the tail of the touched keys, recompute, upsert.

    Ticks are stored by date; a batch reads only the dates from its earliest touched bar, less the look-back, on.
    """
    spark = ticks.sparkSession
    store, out = scratch_path(spark, "refresh-ticks"), scratch_path(spark, "refresh-out")
    seconds = look_back * _seconds(width)

    def step(batch: DataFrame, i: int) -> None:
        batch.withColumn("date", F.to_date("ts")).write.mode("overwrite").partitionBy("date").parquet(f"{store}/batch={i}")
        start = F.unix_seconds(F.min("ts")) - F.unix_seconds(F.min("ts")) % _seconds(width)
        touched = batch.groupBy("symbol").agg(start.alias("_from"))
        first = batch.agg(F.to_date(F.timestamp_seconds(start - seconds))).first()[0]
        seen = spark.read.parquet(store).where((F.col("batch") <= i) & (F.col("date") >= F.lit(first))).drop("batch", "date")
        tail = seen.join(touched, "symbol").where(F.unix_seconds("ts") >= F.col("_from") - seconds)
        fresh = feature(bar_ops.time_bars(tail.drop("_from"), width)).join(touched, "symbol").where(
            F.unix_seconds("ts") >= F.col("_from")).drop("_from")
        _upsert(fresh, i, out, grace)

    drain_each(ticks, step)
    return published.read(spark, out).drop("batch", "date")


def _seconds(width: str) -> int:
    n, unit = width.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def metered(step: Callable[[DataFrame, int], None], out: str) -> Callable[[DataFrame, int], None]:
    """A batch step that also writes one row of metrics per batch (a retried batch replaces its row)."""
    def run(batch: DataFrame, i: int) -> None:
        began = time.time()
        step(batch, i)
        row = (batch.agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(i).cast("long").alias("number"), "rows", F.lit(time.time() - began).alias("seconds")))
        row.write.mode("overwrite").parquet(f"{out}/batch={i}")
    return run


def progress(spark: SparkSession, out: str) -> DataFrame:
    """Batches with data, input rows, mean and longest batch time in seconds and rows per second, over all batches ever."""
    done = spark.read.parquet(out).where("rows > 0")
    return done.agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("input_rows"), F.avg("seconds").alias("mean_seconds"),
                    F.max("seconds").alias("longest_seconds"), F.try_divide(F.sum("rows"), F.sum("seconds")).alias("rows_per_second"))


def time_sliced(df: DataFrame, n: int, order: list[str], files: int = 1) -> str:
    """Write history as n slices in time order, each of at most ``files`` files, ready for replay; returns the folder.

    A file stream takes the oldest file first, so the files' times are set one second apart in that order.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "replay")
    df.repartitionByRange(n * files, *order).sortWithinPartitions(*order).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((st.getPath() for st in fs.listStatus(folder) if st.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, f in enumerate(files):
        fs.setTimes(f, int(time.time() - 60 - len(files) + i) * 1000, -1)
    return path


def replay(df: DataFrame, n: int, order: list[str], rows: int = SLICE_ROWS) -> DataFrame:
    """History as a stream of n batches in time order; no task writes or reads much more than ``rows`` rows, however long a batch is."""
    files = max(1, -(-df.count() // (n * rows)))
    return source(df.sparkSession, time_sliced(df, n, order, files), df.schema, files)


def catch_up(spark: SparkSession, history: DataFrame, live: DataFrame, out: str) -> None:
    """Back-fill first, then the live rows through the same checkpoint, so nothing is read twice."""
    inbox, log = scratch_path(spark, "inbox"), scratch_path(spark, "catch-up-log")
    history.write.mode("append").parquet(inbox)
    for part in (None, live):
        if part is not None:
            part.write.mode("append").parquet(inbox)
        start(source(spark, inbox, history.schema), out, log).awaitTermination()


def better_model(preds: DataFrame, current: str, candidate: str, recent: int, gain: float) -> DataFrame:
    """Accuracy of two prediction columns on the latest rows per key, and whether to switch."""
    r = latest(preds, ["symbol"], ["ts", "seq"], recent)
    hit = lambda c: F.avg((F.col(c) == F.col("actual")).cast("double"))
    g = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), hit(current).alias("current"), hit(candidate).alias("candidate"))
    return g.withColumn("switch", (F.col("candidate") > F.col("current") * (1 + gain)).cast("int"))
