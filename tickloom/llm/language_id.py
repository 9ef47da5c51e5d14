"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, hot_join, slices, text_buffers, without
from tickloom.session import pin

#: Labelled rows that the text model is fitted on (in expectation; chosen by a hash of the row), and its hashed trigrams.
LABELLED, FEATURES = 6000, 1 << 14
#: Labels that can be languages, at most.
LANGUAGES = 256
#: A text weighs as much as this many trigrams at most, for neighbouring trigrams are no independent evidence.
WEIGHT = 60.0
#: Pseudo-counts with which a host leans on its site, a site on all rows; and for declared languages and suffixes.
LEAN, PSEUDO = 8.0, 1.0
#: Least posterior of an accepted language.
SURE = 0.5
#: Weight of the even distribution that is mixed with every language's trigrams.
UNSEEN = 0.1
#: Texts with fewer trigrams are not called noise.
FEW = 60

_fold = np.full(256, 32, np.uint8)  # all but letters is a space
_fold[97:123] = _fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


@dataclass
class TextModel:
    """Log likelihoods of hashed byte trigrams, one row per language."""

    languages: list[str]
    logs: np.ndarray

    @property
    def floor(self) -> float:
        """Mean log likelihood of a trigram in a text of which the language shares next to nothing."""
        return float(np.log(1.2 * UNSEEN / self.logs.shape[1]))


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts of a column, where each text's begin and end in them, and its number of letters (bytes)."""
    data, offsets = text_buffers(column)
    data = _fold[data].astype(np.uint32)
    letters = np.diff(np.concatenate([[0], np.cumsum(data != 32)])[offsets])
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), letters
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    inside = np.ones(len(data), bool)  # a trigram ends in its own text, and has no two spaces in front
    ends = offsets[1:][np.diff(offsets) > 0]
    inside[np.maximum(ends - 1, 0)] = inside[np.maximum(ends - 2, 0)] = False
    inside = inside[:-2] & ((code >> 8) != 0x2020)
    places = np.concatenate([[0], np.cumsum(inside)])
    return ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64), places[np.minimum(offsets, len(inside))], letters


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", labelled: int = LABELLED) -> TextModel:
    """Naive Bayes over about ``labelled`` labelled rows; executors count, the driver gets one row per language and trigram.

    Every language gets an equal part of that number, and all of its rows if it has fewer, so a rare language is not missed;
    of more than ``LANGUAGES`` labels the most frequent ones are languages (ties: the first in order).
    """
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(1 << 20)).alias("place"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    part = labelled / max(len(sizes), 1)
    bounds = docs.sparkSession.createDataFrame([(r["lang"], math.ceil(min(1.0, part / r["count"]) * (1 << 20))) for r in sizes], "lang string, bound long")
    chosen = rows.join(F.broadcast(bounds), "lang").filter("place < bound")  # at most LANGUAGES rows are broadcast

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches):
            grams, places, _ = trigrams(part.column(1))
            for i, lang in enumerate(part.column(0).to_pylist()):
                counts.setdefault(lang, np.zeros(FEATURES, np.int64))
                counts[lang] += np.bincount(grams[places[i]:places[i + 1]], minlength=FEATURES)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])

    found = (chosen.select("lang", "text").mapInArrow(task, "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(found["lang"].unique()) or ["und"]
    counts = np.zeros((len(languages), FEATURES))
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[i, own["gram"].to_numpy(int)] += own["n"].to_numpy(float)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return TextModel(languages, np.log((1 - UNSEEN) * shares + UNSEEN / FEATURES))


def likelihoods(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` without text, with ``grams``, the mean log likelihood of a trigram per language, and the ``best`` language's number."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 19):
            grams, places, letters = trigrams(part.column(1))
            n = np.diff(places)
            means = []
            for logs in shared.value.logs:
                sums = np.concatenate([[0.0], np.cumsum(logs[grams])])
                means.append((sums[places[1:]] - sums[places[:-1]]) / np.maximum(n, 1))
            best = pa.array(np.argmax(means, axis=0).astype(np.int32), mask=n == 0)
            flat = pa.array(np.stack(means, 1).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(means)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(n.astype(np.int64)), pa.array(letters.astype(np.int64)), best, lists],
                                             ["id", "declared", "suffix", "host", "site", "grams", "letters", "best", "means"])
    return rows.select("id", "text", "declared", "suffix", "host", "site").mapInArrow(
        task, "id string, declared string, suffix string, host string, site string, grams long, letters long, best int, means array<double>")


def _vector(columns: list[Column]) -> Column:
    return F.array(*columns)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Per row: ``id, declared, host, text_lang, lang, posterior, accepted``.

    ``rows`` has the string columns id, text, declared, suffix, host and site, any of them null.
    Evidence is added as logs: the mean trigram likelihood times at most ``WEIGHT``; how often texts
    of a language declare what this one declares; how often they lie below this address suffix; and
    the host's share of the language, which leans on its site's and that on the share in all rows. The tables
    behind the last three come from aggregations over all rows by their text's language. A missing
    declaration, suffix or host says nothing. Ties go to the first language in order. ``lang`` is
    ``und`` and the row is not accepted when its text has no letters, or has ``FEW`` trigrams or more of which
    next to none is known to any language, or no language reaches a posterior of ``SURE``. Repeated rows repeat; no rows give none.
    """
    langs = model.languages
    scored = pin(likelihoods(rows, model).withColumn("declared", F.lower(F.substring_index("declared", "-", 1))))
    votes = [F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)).alias(f"n{i}") for i in range(len(langs))]
    n = [F.col(f"n{i}") for i in range(len(langs))]
    hosts = pin(scored.filter(F.col("host").isNotNull()).groupBy("host").agg(F.max("site").alias("site"), F.count(F.lit(1)).alias("rows"), *votes))
    total = scored.agg(*votes).first()
    base = np.array([(total[i] or 0.0) + PSEUDO for i in range(len(langs))])
    base = base / base.sum()
    of_site = hosts.groupBy("site").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(n)])
    site_share = [(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + LEAN * float(base[i])) / (sum(F.coalesce(F.col(f"s{j}"), F.lit(0.0)) for j in range(len(langs))) + LEAN)
                  for i in range(len(langs))]
    host_share = [(n[i] + LEAN * F.col("site_share")[i]) / (sum(n) + LEAN) for i in range(len(langs))]
    priors = (hosts.join(of_site, "site", "left").withColumn("site_share", _vector(site_share))
              .select("host", "rows", F.transform(_vector(host_share), lambda x: F.log(x)).alias("prior")))

    def evidence(column: str) -> DataFrame:
        """Per value: the log of its share among the rows of each language, over its share in all rows."""
        counts = scored.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"), *votes)
        sums = counts.agg(*[F.sum(c) for c in n], F.sum("rows")).first()
        all_rows = float(sums[len(langs)] or 0) + PSEUDO
        shares = [F.log((n[i] + PSEUDO * F.col("rows") / all_rows) / ((sums[i] or 0.0) + PSEUDO) * all_rows / F.col("rows")) for i in range(len(langs))]
        return pin(counts.select(column, "rows", _vector(shares).alias(f"by_{column}")))

    fused = scored
    for column, table, value in (("declared", evidence("declared"), "by_declared"), ("suffix", evidence("suffix"), "by_suffix"), ("host", pin(priors), "prior")):
        fused = pin(hot_join(fused.filter(F.col(column).isNotNull()), table, column, "rows").drop("rows")
                    .unionByName(fused.filter(F.col(column).isNull()).withColumn(value, F.lit(None).cast("array<double>"))))
    nothing = F.array(*[F.lit(0.0)] * len(langs))
    prior = F.array(*[F.lit(float(x)) for x in np.log(base)])
    weight = F.least(F.col("grams").cast("double"), F.lit(WEIGHT))
    logs = [F.col("means")[i] * weight + F.coalesce("by_declared", nothing)[i] + F.coalesce("by_suffix", nothing)[i] + F.coalesce("prior", prior)[i]
            for i in range(len(langs))]
    top = F.array_max(F.transform("logs", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))
    fused = fused.withColumn("logs", _vector(logs)).withColumn("top", top)
    fused = fused.withColumn("posterior", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top.x"))))
    name = F.array(*[F.lit(x) for x in langs])
    accepted = (F.col("letters") > 0) & ((F.col("grams") < FEW) | (F.array_max("means") > model.floor)) & (F.col("posterior") >= SURE)
    return fused.select("id", "declared", "host", F.get(name, F.col("best")).alias("text_lang"),
                        F.when(accepted, F.get(name, -F.col("top.i"))).otherwise("und").alias("lang"), "posterior", accepted.alias("accepted"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: visible text, the language their markup declares, host, site (last two labels) and suffix of the address."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    said = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z-]+)", 1)
    empty = lambda c: F.when(c != "", c)
    return (pages.select(F.col("page_id").cast("string").alias("id"), text.alias("text"), empty(said).alias("declared"), empty(host).alias("host"))
            .withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("site", F.substring_index("host", ".", -2)))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of documents: their text, the language they declare, their source as host."""
    return docs.select(_row_key().alias("id"), body().alias("text"), F.col("lang").cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.col("source").cast("string").alias("host"), F.col("source").cast("string").alias("site"))


def _row_key() -> Column:
    columns = [F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")]
    return F.concat_ws(":", F.xxhash64(F.lit(1), *columns).cast("string"), F.xxhash64(F.lit(2), *columns).cast("string"))


def keep_identified(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """The documents whose language is accepted, every column as it was; equal rows share their fate."""
    found = identify(document_rows(docs), model or fit(docs))
    return without(docs, pin(found.filter(~F.col("accepted")).select("id").distinct()), _row_key())
