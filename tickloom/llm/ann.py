"""Approximate nearest neighbours: learned, balanced partitions of a neighbour graph, and a classifier that routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import pin

#: Vectors that the partitions and the classifier are fitted on, at most; neighbours in their graph; partitions; probed by a query.
SAMPLE, NEIGHBOURS, PARTS, PROBES = 8192, 20, 32, 24
#: Vectors of a partition, and queries, that meet in one block.
BLOCK, QUERIES = 16384, 4096
ROUNDS, HIDDEN, EPOCHS, RATE = 12, 64, 60, 0.01


@dataclass
class Router:
    """A classifier with one hidden layer: vector to partition probabilities."""

    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x * self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2


def graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The ``k`` nearest by inner product of every vector of the sample."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), int)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def partition(near: np.ndarray, parts: int, x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Balanced parts of the graph that cut few edges.

    Grown from splits at medians, then improved: in each round every vector asks for the part that
    most of its neighbours are in, the strongest wishes first, while no part exceeds its share by over 5 %.
    """
    n = len(near)
    part = np.zeros(n, int)
    rng, count = np.random.default_rng(0), 1
    while count < parts:  # halve every part along its widest of a few directions
        new = part.copy()
        for p in range(count):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                centred = x[own] - x[own].mean(axis=0)
                direction = rng.standard_normal(x.shape[1])
                for _ in range(10):
                    direction = centred.T @ (centred @ direction)
                    direction /= np.linalg.norm(direction) or 1.0
                new[own[np.argsort(centred @ direction, kind="stable")[len(own) // 2:]]] += count
        part, count = new, count * 2
    most = int(np.ceil(n / count * 1.05))
    for _ in range(rounds):
        votes = np.zeros((n, count))
        for j in range(near.shape[1]):
            np.add.at(votes, (np.arange(n), part[near[:, j]]), 1.0)
            np.add.at(votes, (near[:, j], part), 1.0)
        wish = votes.argmax(axis=1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=count), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[wish[i]] < most:
                sizes[part[i]] -= 1
                sizes[wish[i]] += 1
                part[i] = wish[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int) -> Router:
    """Fit the router: a vector's target is spread over the parts of itself and its neighbours."""
    rng = np.random.default_rng(1)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), part] += 1.0
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[near[:, j]]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    scale = np.ones(x.shape[1]) / max(np.sqrt((x ** 2).mean()), 1e-300)
    r = Router(scale, rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN),
               rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts))
    names, m, v, step = ("w1", "b1", "w2", "b2"), {}, {}, 0
    z = x * scale
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b, step = order[at:at + 256], step + 1
            h = np.maximum(z[b] @ r.w1 + r.b1, 0)
            s = h @ r.w2 + r.b2
            p = np.exp(s - s.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[b]) / len(b)
            dh = (d @ r.w2.T) * (h > 0)
            for name, g in zip(names, (z[b].T @ dh, dh.sum(0), h.T @ d, d.sum(0)), strict=True):
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                setattr(r, name, getattr(r, name) - RATE * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8))
    return r


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows that take part: id and vector not null, no null or non-finite component, not zero."""
    v = F.col("v")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad & F.exists("v", lambda c: c != 0)))


def fit(rows: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> Router:
    """Fit on at most ``sample`` vectors with the smallest hashes of their ids, so that copies of one vector weigh as rows do."""
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    x = np.stack([np.asarray(v) for v in chosen["v"]])
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    if len(x) < 2 * parts:
        return Router(np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = graph(x)
    return train(x, near, part := partition(near, parts, x), int(part.max()) + 1)


def nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the ``k`` rows with the largest inner product, ties to smaller ids, the query's own id left out.

    A matrix product finds who can be among them; the scores are then summed row by row, so equal vectors get equal scores.
    """
    for at in range(0, len(q), 256):
        s = q[at:at + 256] @ x.T
        s[own[at:at + 256, None] == ids[None, :]] = -np.inf
        top = min(k, s.shape[1])
        least = -np.partition(-s, top - 1, axis=1)[:, top - 1]
        slack = 1e-9 * (np.abs(s).max(axis=1, initial=0, where=np.isfinite(s)) + 1e-300)
        for i in range(len(s)):
            c = np.flatnonzero((s[i] >= least[i] - slack[i]) & np.isfinite(s[i]))
            exact = (x[c] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[c], -exact))[:k]
            yield at + i, ids[c][best], exact[best]


def search(vectors: DataFrame, k: int = 20, every: int = 20, router: Router | None = None, probes: int = PROBES,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` nearest others by inner product: ``query_id, rank, vec_id, score``.

    Every usable row is indexed in the partition that the router finds most likely; a query goes to its
    ``probes`` most likely ones. Partitions are cut into blocks of about ``BLOCK`` rows by a hash of
    the id, so a vector that fills a third of the table still spreads. Scores are exact. Rows with
    null, zero, or non-finite vectors, or without an id, take no part; vectors of another length than the
    fitted ones take none either. Repeated ids are separate candidates. No usable rows, no result.
    """
    rows = usable(vectors, key, vector)
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1).collect()
    if not first:
        return empty
    rows = rows.filter(F.size("v") == len(first[0]["v"]))
    shared = rows.sparkSession.sparkContext.broadcast(router or fit(rows))

    @F.pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        s = shared.value.scores(np.stack(v.to_numpy())) if len(v) else np.zeros((0, 1))
        return pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    routed = pin(rows.withColumn("to", route("v")))
    index = routed.select("vec_id", "v", F.col("to")[0].alias("part"))
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # one row per partition of the router
    index = index.join(F.broadcast(sizes), "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = routed.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // QUERIES))
    asked = (asked.withColumn("g", F.pmod(F.xxhash64("vec_id", F.lit("g")), F.lit(groups)).cast("int")).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("g").alias("qg"), F.explode("to").alias("part"))
             .join(F.broadcast(sizes), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query_id", "q", F.col("part").alias("qpart"), F.col("block").alias("qblock"), "qg"))
    index = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).drop("blocks")

    def block(q: pa.Table, x: pa.Table) -> pa.Table:
        found = []
        if q.num_rows and x.num_rows:
            unpack = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            own = q.column("query_id").to_numpy()
            for i, ids, scores in nearest(unpack(q, "q"), x.column("vec_id").to_numpy(), unpack(x, "v"), own, k):
                found.append((np.full(len(ids), own[i]), ids, scores))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    hits = asked.groupBy("qpart", "qblock", "qg").cogroup(index.groupBy("part", "block", "g")).applyInArrow(block, "query_id long, vec_id long, score double")
    # The best k of a query: sorted arrays of its few partial results, of which every block gave k at most.
    best = hits.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast(T.IntegerType()).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
