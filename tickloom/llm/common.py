"""Shared helpers: hot keys, row ids that cannot clash, Bloom bitmaps, slices of Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import BROADCAST_ROWS

#: Rows of an Arrow batch: texts can be long, and a batch is held several times on its way to Python.
BATCH_ROWS = 1000
#: A key is hot when it holds more than one of this many equal shares of all rows, so at most so many keys are hot.
SHARES = 1000
#: Bits of a Bloom bitmap: for each inserted value, and at most in all (32 MB, the bound of what is broadcast); three hashes.
BITS_PER_VALUE, MAX_BITS, HASHES = 16, 1 << 28, 3


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most ``BATCH_ROWS`` rows set for its session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def forget(spark: SparkSession) -> None:
    """Let Spark delete shuffles and checkpoints that no DataFrame uses; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def body(c: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(c), F.lit(""))


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``table``, which has each ``key`` once and the rows of it in ``weight``.

    Keys with more than one of ``SHARES`` parts of all rows (so at most ``SHARES`` keys, whatever
    the data) are broadcast, and their rows stay where they are; the others meet by a shuffle.
    ``rows`` is read twice and so best comes from a checkpoint. ``how``: inner or left.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // SHARES, 1)
    hot, cold = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(apart)


def bloom_positions(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_bits(rows: int) -> int:
    return int(min(MAX_BITS, max(1 << 20, 1 << int(np.ceil(np.log2(max(rows, 1) * BITS_PER_VALUE))))))


def bloom_filter(values: DataFrame, column: str, bits: int, least: int = 1) -> Callable[[Column], Column]:
    """A test for values of which every bit was set by at least ``least`` rows (false positives, no misses).

    Bits are counted with map-side partials, packed into bitmaps of 32,768 bits, and at most
    ``MAX_BITS`` of them come to the driver and are broadcast. With more values than the bits are
    made for, more rows pass the test; results that look at the passing rows again stay right.
    """
    hits = values.select(F.explode(F.array(*bloom_positions(F.col(column), bits))).alias("p")).groupBy("p").count().filter(F.col("count") >= least)
    maps = (hits.groupBy((F.col("p") / 32768).cast("long").alias("b"))
            .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("m")).collect())
    packed = np.zeros(bits // 8, np.uint8)
    for b, m in maps:
        packed[b * 4096:(b + 1) * 4096] = np.frombuffer(bytes(m), np.uint8)
    return bitmap_test(values.sparkSession, packed)


def bitmap_test(spark: SparkSession, packed: np.ndarray) -> Callable[[Column], Column]:
    shared, bits = spark.sparkContext.broadcast(packed), len(packed) * 8

    @F.arrow_udf("boolean")
    def inside(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        found = np.ones(len(a), bool)
        for p in (a, b, c):
            at = p.to_numpy()
            found &= ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return pa.array(found)

    return lambda c: inside(*bloom_positions(c, bits))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        offsets = text_buffers(batch.column(at))[1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


# Mixing constants of a 64-bit finaliser, and the base of the polynomial over a word's bytes.
MIX_A, MIX_B, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


_letters = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_letters[65:91] = _letters[97:123]  # A-Z count as a-z
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(4096, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) <= n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 4096, BASE, np.uint64)]), dtype=np.uint64)
    return _powers


_power(4096)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, parted by ASCII white space), and each text's number of words."""
    gap = _space[data]
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets[:-1]] = True
    before = np.concatenate([[True], gap[:-1]]) if len(data) else gap
    first = np.flatnonzero(~gap & (before | starts_text[:-1]))
    counts = np.searchsorted(first, offsets[1:]) - np.searchsorted(first, offsets[:-1])
    if not len(first):
        return np.zeros(0, np.uint64), counts
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else \
        np.concatenate([np.zeros(first[0], np.int64), np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))])
    value = _letters[data] * _power(int(place.max()) + 1)[place]
    value[gap] = 0
    return mix(np.add.reduceat(value, first)), counts


def without(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the only column of ``keys`` (distinct, from a checkpoint).

    At most ``BROADCAST_ROWS`` keys are broadcast. With more, rows that a Bloom bitmap of the keys
    shows not to be among them pass straight through and only the others shuffle. A null key is
    never among them. Column names of ``docs`` are free.
    """
    name, n = keys.columns[0], keys.count()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys.withColumnRenamed(name, "key")), "key", "left_anti").select("row.*")
    test = bloom_filter(keys, name, bloom_bits(n))
    rows = rows.withColumn("maybe", test(F.col("key")))
    rest = rows.filter("maybe").join(keys.withColumnRenamed(name, "key"), "key", "left_anti")
    return rows.filter(~F.col("maybe")).select("row.*").unionByName(rest.select("row.*"))
