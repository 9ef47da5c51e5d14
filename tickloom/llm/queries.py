"""Registered queries of this package and, where SQL can say it, the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import ann, bpe, exact_dedup, gnat, language_id, line_dedup, lm_score, near_dedup, packing, secrets, spelling, substring_dedup, warc
from tickloom.llm.common import small_batches
from tickloom.llm.tokens import vocabulary
from tickloom.session import scratch_path

Builder = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf}/{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(_table(spark, sf, "documents"))
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2("text", 256).alias("clean_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM d),
b AS (SELECT line FROM l WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.LEAST_SITES}),
k AS (SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS s FROM l LEFT JOIN b USING (line) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(s) AS clean_sha256 FROM k
"""


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    model = language_id.fit(_table(spark, sf, "documents"))
    out = language_id.identify(language_id.page_rows(_table(spark, sf, "pages")), model)
    return out.withColumnRenamed("id", "page_id").withColumn("page_id", F.col("page_id").cast("long"))


def op3_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.score(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.clean(_table(spark, sf, "documents"))
    return out.select("doc_id", "repeats.n_sentences", "repeats.n_removed", "repeats.first_docs", F.sha2("text", 256).alias("clean_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf, "documents"), words=2)


def op6_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(_table(spark, sf, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_table(spark, sf, "documents")).drop("spans_list")


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf, "documents"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(s) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents) WINDOW t AS (PARTITION BY s)
"""


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf, "pages"), path)
    return warc.page_records(spark, path)


# Base 32 of a digest: every five bits lie within two hexadecimal digits.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead FROM pages),
d AS (SELECT page_id, strlen(s) AS payload_bytes, sha1(s) AS h, lead FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    (('0x' || substr(h, (1 + (5 * i) // 4)::BIGINT, 2))::INTEGER >> (3 - (5 * i) % 4)::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM d
"""


def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(_table(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return gnat.mine(_table(spark, sf, "embeddings"))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Builder]:
    return {"op1_line_dedup": op1_line_dedup, "op2_language_id": op2_language_id, "op3_lm_scoring": op3_lm_scoring, "op4_substring_dedup": op4_substring_dedup, "op5_minhash_dedup": op5_minhash_dedup,
            "op6_nearest": op6_nearest,
            "op7_secret_scan": op7_secret_scan, "op8_bpe": op8_bpe, "op9_exact_dedup": op9_exact_dedup, "op10_packing": op10_packing,
            "op11_warc": op11_warc, "op12_spelling": op12_spelling, "op13_hard_negatives": op13_hard_negatives, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op9_exact_dedup": OP9_SQL, "op11_warc": OP11_SQL, "op13_hard_negatives": OP13_SQL}
