"""Repeated passages: hashes of runs of consecutive sentences, joined over all documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE, MIX_A, bloom_bits, bloom_filter, body, hot_join, mix, slices
from tickloom.session import pin

#: A run has this many sentences and words at least, or as many words as ``LONG`` in fewer sentences; and this many different words.
SENTENCES, WORDS, LONG, DIFFERENT = 3, 20, 30, 12
#: A sentence, or a part of one up to a comma, colon or semicolon, with the white space behind it; a line feed ends one too.
#: Together they give the text. Parts are cut at commas so that a passage put into other text is not glued to it.
SENTENCE = re.compile(r"[^.!?,;:\n]*(?:[.!?,;:]+(?=\s|$)\s*|\n\s*|[.!?,;:]+|$)")


#: Odd bases of the two polynomial hashes of a run.
BASES = BASE, MIX_A


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if s]


class _Window:
    """Words and different words of the sentences between two ends that only move on."""

    def __init__(self, words: list[list[str]]):
        self.words, self.first, self.end, self.held, self.seen = words, 0, 0, 0, {}

    def enough(self) -> bool:
        return (self.held >= LONG or self.held >= WORDS and self.end - self.first >= SENTENCES) and len(self.seen) >= DIFFERENT

    def take(self) -> None:
        for w in self.words[self.end]:
            self.seen[w] = self.seen.get(w, 0) + 1
        self.held += len(self.words[self.end])
        self.end += 1

    def drop(self) -> None:
        for w in self.words[self.first]:
            n = self.seen[w] - 1
            if n:
                self.seen[w] = n
            else:
                del self.seen[w]
        self.held -= len(self.words[self.first])
        self.first += 1


def _shortest(words: list[list[str]]) -> list[int]:
    """Ends of the shortest runs from each sentence, as far as there are any."""
    out, window = [], _Window(words)
    while True:  # the shortest run from a sentence ends no earlier than that from the one before
        while window.end < len(words) and not window.enough():
            window.take()
        if not window.enough():
            return out
        out.append(window.end)
        window.drop()


def _polynomials(digests: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``digests`` between two places, wherever a run stands: sums times powers of a base, less by the powers before it."""
    out = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for n, base in enumerate(BASES):
            powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(digests), x, np.uint64)]), dtype=np.uint64)
                            for x in (base, np.uint64(pow(int(base), -1, 1 << 64))))
            ahead = np.concatenate([[np.uint64(0)], np.cumsum(digests * powers[:-1], dtype=np.uint64)])
            out = mix(out + np.uint64(n) + (ahead[end] - ahead[first]) * back[first])
    return out.view(np.int64)


def runs_of(texts: list[list[str]], ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, first sentence, end and hash of the shortest runs of texts that begin at each sentence and, with ``ends``, of those that end there.

    A run has ``SENTENCES`` sentences and ``WORDS`` words, or ``LONG`` words, and ``DIFFERENT`` different ones. Case and white space do
    not count. What is longer than a run is one too: a sentence of a long one lies in the shortest from its start, or
    else ends a shortest within it. Runs are in the order of texts, firsts and ends.
    """
    text, kept, size, digests, words = [], [], [], [], []
    for n, parts in enumerate(texts):
        for i, s in enumerate(parts):
            own = s.lower().split()
            if own:  # sentences of white space alone are part of none
                text.append(n)
                kept.append(i)
                size.append(len(own))
                words += own
                digests.append(hashlib.blake2b(" ".join(own).encode("utf-8", "replace"), digest_size=8).digest())
    text, kept, held = np.array(text, np.int64), np.array(kept, np.int64), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    over = np.searchsorted(text, text, "right")  # where each sentence's text is over
    end = np.minimum(np.searchsorted(held, held[:-1] + LONG), np.maximum(np.searchsorted(held, held[:-1] + WORDS), np.arange(len(text)) + SENTENCES))
    whole = end <= over
    at = np.flatnonzero(whole)
    dull = [n for n, a, b in zip(text[at].tolist(), held[at].tolist(), held[end[at]].tolist(), strict=True) if len(set(words[a:b])) < DIFFERENT]
    for n in sorted(set(dull)):  # texts where some run must be longer to have enough different words
        lo, hi = np.searchsorted(text, [n, n + 1]).tolist()
        found = _shortest([words[a:b] for a, b in zip(held[lo:hi].tolist(), held[lo + 1:hi + 1].tolist(), strict=True)])
        whole[lo:hi] = np.arange(hi - lo) < len(found)
        end[lo:lo + len(found)] = np.array(found, np.int64) + lo
    first = np.flatnonzero(whole)
    end = end[first]
    if ends and len(first):  # the shortest run to an end begins at the last sentence whose own shortest run is over by then
        to = np.arange(1, len(text) + 1)
        last = np.searchsorted(end, to, "right") - 1
        some = (last >= 0) & (text[first[last]] == text)
        pairs = np.unique(np.concatenate([first << 32 | end, first[last[some]] << 32 | to[some]]))
        first, end = pairs >> 32, pairs & 0xFFFFFFFF
    return text[first], kept[first], kept[end - 1] + 1, _polynomials(np.frombuffer(b"".join(digests), "<u8"), first, end)


def runs(parts: list[str], ends: bool = True) -> list[tuple[int, int, int]]:
    """``(first, end, hash)`` of the runs of one text, see ``runs_of``."""
    return list(zip(*(x.tolist() for x in runs_of([parts], ends)[1:]), strict=True))


def _key() -> Column:
    """What rows with equal id and text share; a null id is before all others."""
    return F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(body()).alias("b"))


def _copies(docs: DataFrame) -> DataFrame:
    """Keys of more than one row."""
    return pin(docs.groupBy(_key().alias("k")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("k"))


def repeated(docs: DataFrame, ends: bool = True, copies: DataFrame | None = None) -> DataFrame:
    """Runs that occur more than once, but for their first place: ``k, copy, first, end, first_doc``.

    ``k`` is the key of a document's rows; of rows with one key, one has ``copy`` 0 and all others 1. The
    first place of a run is the one with the smallest id, then the smallest hash of the text, then the earliest sentence; a null id
    comes before all others. Every run's hash is counted with map-side partials; of the places, only those
    that pass a Bloom bitmap of the repeated hashes shuffle. A row per document, with the arrays of its runs, is checkpointed for the two passes.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text, *found = runs_of([sentences(t) for t in part.column(3).to_pylist()], ends)
            at = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.ListArray.from_arrays(at, pa.array(x.astype(t))) for x, t in zip(found, (np.int32, np.int32, np.int64), strict=True)]],
                                             ["named", "id", "b", "first", "end", "h"])
    texts = pin(docs.select(_key().alias("k"), body().alias("text")).select("k.*", "text").mapInArrow(
        task, "named boolean, id long, b long, first array<int>, end array<int>, h array<long>"))  # each text is cut and hashed once
    places = texts.select("named", "id", "b", F.inline(F.arrays_zip("first", "end", "h")))
    hashes = pin(texts.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("h"))
    met = pin(places.filter(bloom_filter(hashes, "h", bloom_bits(hashes.count()))(F.col("h"))))
    place = F.struct("named", "id", "b", "first")
    origins = pin(met.groupBy("h").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    joined = hot_join(met, origins, "h", "rows").select(
        F.struct("named", "id", "b").alias("k"), "first", "end", F.when(F.col("origin.named"), F.col("origin.id")).alias("first_doc"), (place == F.col("origin")).alias("own"))
    out = joined.filter("not own").select("k", F.lit(0).alias("copy"), "first", "end", "first_doc")
    copies = _copies(docs) if copies is None else copies
    if not copies.isEmpty():  # whatever a copy holds came first in the row it repeats, or before that
        out = out.unionByName(joined.select("k", F.lit(1).alias("copy"), "first", "end", "first_doc").distinct().join(copies, "k", "left_semi"))
    return pin(out)


def _strip(text: str, ranges: list) -> tuple[str, int, int]:
    """The text without the sentences in ``ranges``, the number of its sentences, and of those that went."""
    parts = sentences(text)
    gone = {i for r in ranges for i in range(r[0], r[1])}
    kept = [s for i, s in enumerate(parts) if i not in gone]
    return "".join(kept).rstrip() if gone else text, len(parts), len(gone & set(range(len(parts))))


def _numbered(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """``row, k`` of every row; ``k`` ends with ``copy``: 0 for one row of each key, 1 for the others. Only rows that may be copies shuffle."""
    rows = docs.select(F.struct("*").alias("row"), _key().alias("k"))
    n = copies.count()
    if not n:
        return rows.select("row", F.struct("k.*", F.lit(0).alias("copy")).alias("k"))
    rows = rows.withColumn("maybe", bloom_filter(copies, "k", bloom_bits(n))(F.col("k")))
    some = pin(rows.filter("maybe").select("row", "k", F.monotonically_increasing_id().alias("n")))
    leads = pin(some.groupBy("k").agg(F.min("n").alias("lead"), F.count(F.lit(1)).alias("rows")))
    both = hot_join(some, leads, "k", "rows").select("row", "k", (F.col("n") > F.col("lead")).cast("int").alias("copy"))
    return rows.filter(~F.col("maybe")).select("row", "k", F.lit(0).alias("copy")).unionByName(both).select("row", F.struct("k.*", "copy").alias("k"))


def remove_repeats(docs: DataFrame, ends: bool = False) -> DataFrame:
    """Of ``clean``, the documents that hold a non-first repeated run; without ``ends`` only the shortest run from each sentence counts."""
    return clean(docs, ends).filter("repeats.n_removed > 0")


def clean(docs: DataFrame, ends: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with cleaned ``text``, and a struct ``repeats`` (n_sentences, n_removed,
    first_docs: ids of the documents where the removed runs came first).

    Every sentence of every repeated run goes, but for the run's first place. Null text is empty and has no runs.
    Rows that repeat an id are documents of
    their own, also those with a null id (which ``first_docs`` cannot name); of rows with equal id and text one is the
    first. Very long texts are read whole. Texts without such runs do not shuffle. No rows in, none out.
    """
    copies = _copies(docs)
    found = repeated(docs, ends, copies).select(F.struct("k.*", "copy").alias("k"), "first", "end", "first_doc")
    ranges = pin(found.groupBy("k").agg(F.collect_set(F.struct("first", "end")).alias("ranges"), F.sort_array(F.collect_set("first_doc")).alias("first_docs")))
    test = bloom_filter(ranges, "k", bloom_bits(ranges.count()))
    rows = _numbered(docs, copies).withColumn("maybe", test(F.col("k")))
    some = rows.filter("maybe").drop("maybe")
    if copies.isEmpty():
        some = some.join(ranges, "k", "left")
    else:  # a key can have very many rows
        some = pin(some)
        weights = some.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
        some = hot_join(some, pin(weights.join(ranges, "k", "left")), "k", "rows")

    @F.pandas_udf("text string, n_sentences long, n_removed long")
    def strip(texts, lists):
        import pandas as pd
        return pd.DataFrame([_strip(t, [(r["first"], r["end"]) for r in rs] if rs is not None else []) for t, rs in zip(texts, lists, strict=True)], columns=["text", "n_sentences", "n_removed"])

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(sentences(t)) for t in texts.to_pylist()], pa.int64())

    none = F.array().cast("array<long>")
    done = some.withColumn("s", strip(body("row.text"), "ranges")).select("row", "s.text", "s.n_sentences", "s.n_removed", F.coalesce("first_docs", none).alias("first_docs"))
    rest = rows.filter(~F.col("maybe")).select("row", body("row.text").alias("text"), count(body("row.text")).alias("n_sentences"), F.lit(0).cast("long").alias("n_removed"), none.alias("first_docs"))
    names = [c for c in docs.columns if c != "repeats"]
    return done.unionByName(rest).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names],
                                         F.struct("n_sentences", "n_removed", "first_docs").alias("repeats"))
