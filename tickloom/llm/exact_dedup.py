"""Exact duplicates: two passes with Bloom filters, so that only possibly repeated texts shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bloom_bits, bloom_filter, body, hot_join
from tickloom.session import pin


def _maybe(docs: DataFrame, text: str):
    """First pass: a test for text hashes whose every bit was set at least twice."""
    hashes = docs.select(F.xxhash64(body(text)).alias("h"))
    return bloom_filter(hashes, "h", bloom_bits(docs.count()), least=2)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays. The
    first pass counts, for a bitmap of 16 bits a row (at most 32 MB), which bits two or more rows
    set; the second lets rows with an unset bit straight through, for no equal text exists. Only
    the others shuffle, as a digest and an id. Rows that repeat an id and its text are one document,
    counted in ``group_size``; one id with several texts is as many documents. A null id counts
    as the smallest and stays only where all ids of its text are null. No rows in, no rows out.
    """
    test = _maybe(docs, text)
    rows = pin(docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body(text)).alias("h"), F.sha2(body(text), 256).alias("s"))
               .select("doc_id", F.unhex("s").alias("digest"), test(F.col("h")).alias("maybe")))
    shown = lambda *c: [F.col("doc_id"), *c, F.lower(F.hex("digest")).alias("text_sha256")]
    alone = rows.filter(~F.col("maybe")).select(*shown(F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))
    met = pin(rows.filter("maybe").groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")))
    groups = met.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("members"))
    joined = hot_join(met, groups, "digest", "members")
    return alone.unionByName(joined.select(*shown(F.col("keep_id"), F.col("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without exact copies, every column as it was: of equal texts one row with the largest id stays.

    Rows without an equal text never shuffle; the rest are reduced per text before and after one
    exchange. Of rows that share both text and id, any one stays. Column names of ``docs`` are free.
    """
    test = _maybe(docs, text)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(body(text)).alias("h")).withColumn("maybe", test(F.col("h")))
    rank = F.struct(F.col(f"row.`{key}`").isNotNull(), F.col(f"row.`{key}`"))
    best = (rows.filter("maybe").groupBy(F.sha2(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), 256).alias("digest"))
            .agg(F.max_by("row", rank).alias("row")))
    return rows.filter(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))
