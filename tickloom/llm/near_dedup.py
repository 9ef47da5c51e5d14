"""Near duplicates: banded MinHash, signatures, exact confirmation on whole sets, components by large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bloom_bits, bloom_filter, body, forget, hot_join, mix, slices, text_buffers, without, word_hashes
from tickloom.session import pin

#: Bands and rows of a band: two sets with similarity 0.8 share no band with probability (1 - 0.8^4)^32 < 5e-8.
BANDS, ROWS = 32, 4
#: Words of a shingle, and the least similarity in per cent.
WORDS, PERCENT = 5, 80
#: Of 128 signature bytes, this many must agree; 5.5 standard deviations below what a similarity of 0.8 gives.
AGREE = 78
#: Shingles of the members of a bucket in one block, which meets others in one group; members in a group, about.
BLOCK, GROUP = 200_000, 1000

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct 64-bit shingles of ``words`` words; with fewer words the whole sequence is one, with none there is none."""
    hashes, counts = word_hashes(*text_buffers(column))
    ends = np.cumsum(counts)
    width = max(len(hashes) - words + 1, 0)
    with np.errstate(over="ignore"):
        runs = np.zeros(width, np.uint64)
        for j in range(words):
            runs = mix(runs * _C + hashes[j:j + width] + np.uint64(j + 1)) if width else runs
        for end, n in zip(ends, counts, strict=True):
            if n >= words:
                yield np.unique(runs[end - n:end - words + 1])
            elif n:
                value = np.array([n], np.uint64) * np.uint64(0x5851F42D4C957F2D)
                for h in hashes[end - n:end]:
                    value = mix(value * _C + h)
                yield value
            else:
                yield np.zeros(0, np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash over a set, by slabs."""
    best = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1024):
        np.minimum(best, (_A[:, None] * s[None, at:at + 1024] + _B[:, None]).min(axis=1), out=best)
    return best >> np.uint64(32)


def features(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n`` (set size), ``key`` (128-bit hash of the set), ``bands`` (bucket keys), ``sig`` (a byte per hash)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, BANDS + 1, dtype=np.uint64)
        for part in slices(batches, limit=1 << 19):
            sizes, keys, bands, sigs = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(part.column(1), words):
                    sizes.append(len(s))
                    keys.append(np.array([mix(s).sum(), mix(s ^ _C).sum()], np.uint64).tobytes())
                    if not len(s):
                        bands.append(None)
                        sigs.append(None)
                        continue
                    low = minima(s)
                    band = number * _C
                    for row in low.reshape(BANDS, ROWS).T:
                        band = mix(band * _C + row)
                    bands.append(band.astype(np.int64))
                    sigs.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                                              pa.array(sigs, pa.binary())], ["doc_id", "n", "key", "bands", "sig"])
    return _rows(docs).mapInArrow(task, "doc_id long, n long, key binary, bands array<long>, sig binary")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))


def _sets(docs: DataFrame, ids: DataFrame, count: int, words: int) -> DataFrame:
    """``id, s``: whole sets, made again from the texts, of the documents that pass a Bloom bitmap of ``ids``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 19):
            sets = [s.view(np.int64) for s in shingle_sets(part.column(1), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])
    test = bloom_filter(ids, "id", bloom_bits(count))
    return _rows(docs).filter(F.col("doc_id").isNotNull() & test(F.col("doc_id"))).mapInArrow(task, "id long, s array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), from a checkpoint, those whose whole sets are similar enough.

    A document with many partners makes a large partition of a plain sort-merge join, which Spark can split.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = _sets(docs, ids, 2 * pairs.count(), words)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (a, b); the root is the component's smallest node.

    Alternating large-star and small-star until nothing changes. A node's neighbours are never
    gathered: their minimum is aggregated, and hot nodes meet it by a bounded broadcast.
    """
    def stars(pairs: DataFrame, small: bool) -> DataFrame:
        """``pairs``: every edge as (u, v) seen from u; small: only with v < u."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        met = hot_join(pairs, least, "u", "degree").withColumn("m", F.least("u", "m"))
        out = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            met.select("u", F.col("m").alias("v"))) if small else met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = pin(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = state(now)
    while True:
        both = pin(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = pin(stars(both, small=False))
        now = pin(stars(large, small=True))
        forget(edges.sparkSession)
        if seen == (seen := state(now)):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _dealt(marked: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of buckets with several components, once for each pair of blocks they meet in: ``bucket, i, j, own, id, root, n, sig, bands, slot``.

    The members of a bucket's largest component have blocks of their own, which meet only the blocks of the others.
    A slot has about ``GROUP`` rows, or one pair of blocks.
    """
    open_ = pin(marked.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("rows"))
                .filter(F.col("low") != F.col("high")).select("bucket", "rows"))
    met = pin(hot_join(marked, open_, "bucket", "rows").drop("rows"))
    sizes = met.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    shape = sizes.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "root", "n")).alias("most"))
    shape = pin(shape.select("bucket", "rows", F.col("most.root").alias("big"), F.col("most.rows").alias("within"),
                             F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("inner")))
    copies = shape.agg(F.sum((F.col("rows") - F.col("within")) * (F.col("outer") + F.col("inner")) + F.col("within") * F.col("outer"))).first()[0] or 0
    slots = max(1, int(copies // GROUP))
    rows = hot_join(met, shape, "bucket", "rows").join(reps.select(F.col("doc_id").alias("id"), "sig", "bands"), "id")
    apart, at = F.col("root") != F.col("big"), F.xxhash64("id", "bucket")
    cut = rows.withColumn("own", F.when(apart, F.pmod(at, F.col("outer"))).otherwise(F.col("outer") + F.pmod(at, F.col("inner"))).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("outer") - 1 + F.when(apart, F.col("inner")).otherwise(0))))
    return cut.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "n", "sig", "bands").withColumn(
        "slot", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(slots)).cast("int"))


def _crossing(docs: DataFrame, members: DataFrame, labels: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between documents of one bucket but of different components: ``a, b``, enough of them to join what is linked.

    Buckets within one component drop out. In the others, blocks of members meet blocks in tasks of
    bounded size: once to see by signatures who has a partner, then, for those, with their whole sets.
    A pair is looked at in its first common bucket, and not at all once links of the task join its components.
    """
    marked = pin(members.join(labels, members["id"] == labels["node"], "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root")))
    by = _dealt(marked, reps)
    kinds = "bucket long, i int, j int, own int, id long, root long, n long, sig binary, bands array<long>, slot int"
    seen = pin(by.groupBy("slot").applyInArrow(lambda t: _Slot(t, percent).partners(t), kinds))
    ids = seen.select("id").distinct()
    full = seen.join(_sets(docs, ids, seen.count(), words), "id")
    return full.groupBy("slot").applyInArrow(lambda t: _Slot(t, percent).links(t.column("s").combine_chunks()), "a long, b long").distinct()


class _Slot:
    """The blocks of one task, as arrays."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.bucket, self.i, self.j, self.own, self.id, self.root, self.n = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "id", "root", "n"))
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(self.id), -1)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.id), -1)

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with the rows of its block pair that may be linked to it, every pair from one side."""
        order = np.lexsort((self.own, self.j, self.i, self.bucket))
        change = np.flatnonzero((np.diff(self.bucket[order]) != 0) | (np.diff(self.i[order]) != 0) | (np.diff(self.j[order]) != 0)) + 1
        for rows in np.split(order, change):
            i, j = self.i[rows[0]], self.j[rows[0]]
            left = rows[self.own[rows] == i]
            right = rows[self.own[rows] == j]
            for at, x in enumerate(left):
                y = right[at + 1:] if i == j else right
                y = y[self.root[y] != self.root[x]]
                y = y[100 * np.minimum(self.n[y], self.n[x]) >= self.percent * np.maximum(self.n[y], self.n[x])]
                if len(y):
                    y = y[(self.sig[y] == self.sig[x]).sum(axis=1) >= AGREE]
                if len(y):
                    common = self.bands[y] == self.bands[x]
                    y = y[self.bands[x][common.argmax(axis=1)] == self.bucket[x]]
                if len(y):
                    yield x, y

    def partners(self, table: pa.Table) -> pa.Table:
        met = np.zeros(len(self.id), bool)
        for x, y in self.candidates():
            met[x] = met[y] = True
        return table.filter(pa.array(met))

    def links(self, sets: pa.ListArray) -> pa.Table:
        values, offsets = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while (above := up.get(r, r)) != r:
                up[r] = r = up.get(above, above)
            return r

        found = []
        for x, ys in self.candidates():
            own = values[offsets[x]:offsets[x + 1]]
            for at in range(0, len(ys), 64):
                y = np.array([k for k in ys[at:at + 64] if top(int(self.root[k])) != top(int(self.root[x]))], int)
                if not len(y):
                    continue
                parts = [values[offsets[k]:offsets[k + 1]] for k in y]
                flat = np.concatenate(parts)
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                same = np.add.reduceat((own[place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]))
                for k in y[100 * same >= self.percent * (len(own) + np.array([len(p) for p in parts]) - same)]:
                    a, b = top(int(self.root[x])), top(int(self.root[k]))
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        found.append((int(self.id[x]), int(self.id[k])))
        return pa.table([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets of ``words``-word shingles (A-Z lower-cased, ASCII white
    space parts words; null text is empty) have a similarity of ``percent`` or more; a component's id is its
    smallest. Documents with equal sets form one class at once, by aggregation. Classes meet in buckets of equal bands:
    each is first confirmed against the pivot it shares most buckets with; then, of what the
    components leave open, pairs of different components in a bucket, until no link can join two more. Every link rests on whole sets.
    Texts without words are linked with nothing. Rows that repeat an id are one node with all their
    links. A null id has no component and is kept. No rows in, no rows out.
    """
    feats = pin(features(docs, words))
    usable = feats.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = pin(usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    reps = pin(usable.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").select("doc_id", "n", "bands", "sig"))
    banded = reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("bucket"))
    first = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("pivot"), F.col("n").alias("pn"))
    buckets = pin(banded.groupBy("bucket").agg(F.min(first).alias("p"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select("bucket", "p.pivot", "p.pn", "rows"))
    members = pin(banded.filter(bloom_filter(buckets, "bucket", bloom_bits(buckets.count()))(F.col("bucket"))))
    star = hot_join(members, buckets, "bucket", "rows").filter((F.col("id") != F.col("pivot")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
    shared = star.groupBy("id", "pivot").count()
    best = shared.groupBy("id").agg(F.max(F.struct(F.col("count"), -F.col("pivot"))).alias("m"))
    pairs = pin(best.select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b")))
    links = pin(confirm(docs, pairs, words, percent))
    labels = pin(components(links))
    forget(docs.sparkSession)
    more = pin(_crossing(docs, members, labels, reps, words, percent))
    if not more.isEmpty():
        labels = pin(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    forget(docs.sparkSession)
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("key", F.coalesce("root", "rep").alias("component_id"), "rows")
    out = hot_join(usable.select("doc_id", "key", "n"), pin(named), "key", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = feats.filter(F.col("doc_id").isNull() | (F.col("n") == 0)).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near duplicates, every column as it was: of each component the one with the smallest id stays."""
    lost = near_groups(docs, words, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return without(docs, pin(lost), F.col("doc_id").cast("long"))
