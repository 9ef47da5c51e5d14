"""From raw documents to packed training sequences: five stages, each over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, language_id, near_dedup, packing, secrets
from tickloom.llm.common import small_batches
from tickloom.llm.tokens import vocabulary
from tickloom.session import scratch_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language stay; the rejected ones go."""
    return language_id.keep_identified(small_batches(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.keep_one(small_batches(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the document with the smallest id stays."""
    return near_dedup.keep_one(small_batches(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark."""
    return secrets.redact(small_batches(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, placed in full sequences, with the ids themselves."""
    return packing.pack(small_batches(docs), vocabulary("word_bpe_49k.json"), with_ids=True, cached=PACK_WORDS)


#: Words that a packing worker keeps, twice; few, because workers of earlier stages still hold memory.
PACK_WORDS = 50_000
STAGES = [("language", identify), ("exact", exact), ("near", near), ("secrets", redact), ("pack", pack)]
#: Language models, MinHash groups and learned automata are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
