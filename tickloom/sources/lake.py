"""Batch sources and sinks: Parquet, CSV, JSON lines, and a lake partitioned by symbol, type and date."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.operators import dedupe
from tickloom.operators.cleaning import rename_aliases, sample_rows
from tickloom.session import small_side

#: Text form of timestamps; the default of CSV and JSON writers would cut microseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# ---- reading -----------------------------------------------------------------

def load(spark: SparkSession, paths: list[str], types: list[str] | None = None, start: str | None = None,
         end: str | None = None, sample: int | None = None, type_col: str = "type", ts: str = "ts", key: str = "seq") -> DataFrame:
    """Parquet from files or folders with type and time filters and a repeatable sample."""
    df = spark.read.parquet(*paths)
    if types:
        df = df.where(F.col(type_col).isin(types))
    df = between(df, ts, start, end)
    return sample_rows(df, key, sample) if sample else df


def between(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Half-open time filter whose literals have the column's own type, so that the scan gets it."""
    kind = dict(df.dtypes)[ts]
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    return df.where(F.col(ts) < F.lit(end).cast(kind)) if end else df


def read_csv(spark: SparkSession, path: str, names: T.StructType, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV with a known schema, foreign column names mapped, optional time filter."""
    return between(rename_aliases(spark.read.csv(path, header=True, schema=names, timestampFormat=MICROS), schema.ALIASES), "ts", start, end)


def read_tick_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tick files whose date and time are integers (yyyymmdd, hhmmss)."""
    raw = spark.read.csv(path, header=True, schema=schema.TICK_CSV)
    stamp = F.concat(F.col("`<date>`").cast("string"), F.lpad(F.col("`<time>`").cast("string"), 6, "0"))
    return raw.select(F.to_timestamp(stamp, "yyyyMMddHHmmss").alias("ts"), *[
        F.col(f"`{c}`").alias(c.strip("<>")) for c in raw.columns[2:]])


def read_jsonl(spark: SparkSession, path: str, names: T.StructType, epoch: str = "timestamp") -> DataFrame:
    """JSON lines with epoch seconds."""
    return spark.read.schema(names).json(path).withColumn("ts", F.timestamp_seconds(epoch)).drop(epoch)


def read_lake(spark: SparkSession, root: str, symbol: str | None = None, data_type: str | None = None, start: str | None = None,
              end: str | None = None, weekdays: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Partition-pruned read; the date range prunes folders, not rows."""
    df = spark.read.parquet(root)
    for c, x in (("symbol", symbol), ("data_type", data_type)):
        if x is not None:
            df = df.where(F.col(c) == x)
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if weekdays:
        df = df.where(F.weekday("date") < 5)
    return df.select(*columns) if columns else df


def read_books(spark: SparkSession, offer: str, price: str, symbol_col: str, symbol, since: str) -> DataFrame:
    """Offer and price books of one symbol with their kind as a column, from a look-back date on."""
    one = lambda path, kind: between(spark.read.parquet(path).where(F.col(symbol_col) == symbol), "ts", since, None).withColumn("book_type", F.lit(kind))
    return one(offer, "offer").unionByName(one(price, "price"), allowMissingColumns=True)


def time_travel(df: DataFrame, symbol: str, start: str, end: str, count: int) -> DataFrame:
    """Earliest ``count`` rows of a symbol in a time range, with milliseconds decoded to a timestamp."""
    t = df.where(F.col("symbol") == symbol).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    return between(t, "ts", start, end).orderBy("ts", "seq").limit(count)


# ---- writing -----------------------------------------------------------------

def write_lake(df: DataFrame, root: str, data_type: str, quality: float | None = None, minimum: float = 0.5, codec: str = "gzip") -> bool:
    """Write by symbol, type and date with narrow types; refuse data below the quality limit.

    Range partitioning by (symbol, ts) spreads a hot symbol or day over several files.
    """
    if quality is not None and quality < minimum:
        return False
    out = df.withColumns({"data_type": F.lit(data_type), "date": F.to_date("ts")})
    narrow = {c: F.col(c).cast("float") for c, t in df.dtypes if t == "double"}
    (out.withColumns(narrow).repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy("symbol", "data_type", "date").parquet(root))
    return True


def consolidate(df: DataFrame, root: str, by: str, order: list[str]) -> DataFrame:
    """Rewrite many files by ``by``, each sorted in time; a hot value is split over several files."""
    df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(root)
    return df.sparkSession.read.parquet(root)


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def merge_into(new: DataFrame, root: str, keys: list[str], order: list[str]) -> None:
    """Append to the lake, keeping the last row per key, rewriting only the dates that ``new`` touches.

    The touched dates, a few days of a daily load, are collected and become a partition filter of
    the read.  The new days are written to a hidden folder beside the old ones, which are moved aside and
    deleted only when their successors are in place; the next merge puts back what a lost one left aside.
    ``published`` has tables without that moment between two renames.
    """
    spark = new.sparkSession
    fs, path = _files(spark, root)
    _recover(fs, path, root)
    new = new.withColumn("date", F.to_date("ts"))
    staged = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    if fs.exists(path(root)):
        days = [r.date for r in new.select("date").distinct().collect()]
        both = touched(spark, root, days).select(*new.columns).unionByName(new)
    else:
        both = new
    dedupe.keep(both, keys, order, last=True).repartitionByRange("date", *keys).sortWithinPartitions(*keys).write.partitionBy("date").parquet(staged)
    for st in fs.listStatus(path(staged)):
        name = st.getPath().getName()
        if name.startswith("date="):
            aside = path(f"{root}/.old-{name}")
            if fs.exists(path(f"{root}/{name}")):
                fs.rename(path(f"{root}/{name}"), aside)
            _swap_in(fs, st.getPath(), path(f"{root}/{name}"))
            fs.delete(aside, True)
    fs.delete(path(staged), True)


def _swap_in(fs, new, live) -> None:
    if not fs.rename(new, live):
        raise OSError(f"{live} could not be put in place")


def _recover(fs, path, root: str) -> None:
    """Days that a lost merge had moved aside come back, unless their successor is there."""
    for st in fs.globStatus(path(f"{root}/.old-date=*")) or []:
        live = path(f"{root}/{st.getPath().getName()[5:]}")
        if fs.exists(live):
            fs.delete(st.getPath(), True)
        else:
            fs.rename(st.getPath(), live)


def touched(spark: SparkSession, root: str, days: list) -> DataFrame:
    """The lake's rows of the given dates; other folders are not read."""
    return spark.read.parquet(root).where(F.col("date").isin(days))


def training_ready(df: DataFrame) -> DataFrame:
    return df.dropDuplicates().withColumns({"hour": F.hour("ts"), "minute": F.minute("ts"), "second": F.second("ts")})


def consolidation_window(df: DataFrame, day: str, period: str) -> DataFrame:
    """Rows of the day, the Monday-to-day week, or the month of ``day``; periods close on business days only."""
    d = F.lit(day).cast("date")
    business = F.weekday(d) < 5
    first = {"daily": d, "weekly": F.date_trunc("week", d).cast("date"), "monthly": F.trunc(d, "month")}[period]
    month_end = F.last_day(d)
    last_business = F.date_sub(month_end, F.greatest(F.weekday(month_end) - 4, F.lit(0)))
    closes = {"daily": business, "weekly": F.weekday(d) == 4, "monthly": d == last_business}[period]
    return df.where(closes & (F.to_date("ts") >= first) & (F.to_date("ts") <= d))


def drop_before(spark: SparkSession, root: str, cutoff: str) -> list[str]:
    """Retention: remove date folders before ``cutoff`` at any depth of the layout; touches folder names, not data."""
    fs, path = _files(spark, root)
    gone, todo = [], [path(root)]
    while todo:
        for st in fs.listStatus(todo.pop()):
            name = st.getPath().getName()
            if not st.isDirectory() or "=" not in name:
                continue
            if not name.startswith("date="):
                todo.append(st.getPath())
            elif name[5:] < cutoff:
                fs.delete(st.getPath(), True)
                gone.append(name[5:])
    return sorted(gone)


def compact(spark: SparkSession, source: str, target: str, before: str, rows_per_file: int = 5_000_000, codec: str = "zstd") -> DataFrame:
    """Rewrite old dates with fewer files and a stronger codec; a large day is spread over several tasks and files."""
    old = spark.read.parquet(source).where(F.col("date") < F.lit(before).cast("date"))
    days = small_side(old.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")))
    salt = F.pmod(F.xxhash64(*[c for c in old.columns if c != "date"]), F.col("_files"))
    (old.join(days, "date").withColumn("_salt", salt).repartition("date", "_salt").drop("_salt", "_files")
     .write.mode("overwrite").option("compression", codec).partitionBy("date").parquet(target))
    return spark.read.parquet(target)


def write_datasets(df: DataFrame, root: str) -> DataFrame:
    """Split/regime folders plus a metadata table written as JSON."""
    df.write.mode("overwrite").partitionBy("split", "regime").parquet(f"{root}/data")
    meta = df.groupBy("split", "regime").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    meta.write.mode("overwrite").json(f"{root}/metadata")
    return df.sparkSession.read.parquet(f"{root}/data")


def export(df: DataFrame, path: str, kind: str) -> None:
    w = df.write.mode("overwrite").option("timestampFormat", MICROS)
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def payload(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Feature columns as one JSON map, with their number."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    return df.select(*keys, F.to_json(F.create_map(*pairs)).alias("payload"), F.lit(len(features)).alias("feature_count"))


def unpack(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    m = F.from_json("payload", T.MapType(T.StringType(), T.DoubleType()))
    return df.withColumn("_m", m).select(*keys, *[F.col("_m")[f].alias(f) for f in features])


def split_trades_candles(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a side are trades, rows without are candles; both get their calendar day."""
    d = df.withColumn("date", F.to_date("ts"))
    return d.where(F.col("side").isNotNull()), d.where(F.col("side").isNull())


def describe(df: DataFrame, type_col: str, price: Column, ts: str = "ts") -> DataFrame:
    """Counts, price statistics and time range per event type."""
    return df.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("rows"), F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.avg(price).alias("price_mean"),
        F.stddev_samp(price).alias("price_std"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def source_info(df: DataFrame, ts: str) -> DataFrame:
    """Files, bytes, rows, columns and time range of a file-based table."""
    per = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"), F.col(ts).alias("t")).groupBy("f", "s").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("s").alias("bytes"), F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                   F.min("a").alias("first"), F.max("b").alias("last"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
