"""Hard negatives: exact searches of score windows in a multiway tree of split points with distance ranges."""

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

#: Vectors that the split points of the upper tree are chosen from (all rows are assigned and measured), and such points at most.
SAMPLE, TOP = 4096, 256
#: Split points of an inner node, rows of a leaf, rows of a block (a subtree of one task), windows that meet a block at once, levels of a block's tree at most.
WAYS, LEAF, BLOCK, WINDOWS, DEPTH = 12, 256, 16_384, 8192, 12
#: Squared lengths below this give exact scores in double precision; above, rows are compared as whole numbers without a tree.
EXACT, WIDEST = 2.0 ** 52, 2.0 ** 62
SLACK = 1e-7


@dataclass
class Space:
    """Scores as distances: with a last component that gives every row the squared length ``square``, and is zero for an
    anchor, the squared distance is anchor's square + square - 2 * score."""

    square: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def distances(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
        return np.sqrt(np.maximum(d, 0))

    def annulus(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest and farthest distance that scores from ``low`` to ``high`` can have, a little wider than rounding needs."""
        whole = (anchors * anchors).sum(axis=1) + self.square
        ring = lambda s: np.sqrt(np.maximum(whole - 2 * s, 0))
        slack = SLACK * (np.sqrt(whole) + 1)
        return ring(high) - slack, ring(np.maximum(low, -whole)) + slack


def open_ways(d: np.ndarray, near: np.ndarray, far: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which siblings each window must enter.

    ``d``: distances of the anchors to the split points; ``lows``, ``highs``: [i, j] is the range of distances from point i
    to the subtree of j. A point's view rules a sibling out where its range, moved by the anchor's own distance to
    the point, misses the window's annulus.
    """
    stay = np.ones((len(d), lows.shape[1]), bool)
    slack = SLACK * (highs.max(initial=0, where=np.isfinite(highs)) + 1)
    for i in range(lows.shape[0]):
        own = d[:, i, None]
        closest = np.maximum(lows[i] - own, own - highs[i])
        stay &= (closest <= far[:, None] + slack) & (own + highs[i] >= near[:, None] - slack)
    return stay


def choose_points(x: np.ndarray, ways: int) -> np.ndarray:
    """Split points far from each other: each next one is the row farthest from those chosen; fewer where rows are alike."""
    chosen = [int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    apart = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < ways and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class Tree:
    """Rows of a block: nodes of split points with ranges to all siblings, down to leaves of at most ``LEAF`` rows or of equal ones."""

    def __init__(self, lifted: np.ndarray, space: Space, leaf: int = LEAF):
        self.space, self.leaf = space, leaf
        self.root = self._grow(np.arange(len(lifted)), lifted)

    def _grow(self, rows: np.ndarray, x: np.ndarray, depth: int = 0):
        if len(rows) <= self.leaf or depth == DEPTH:
            return rows
        sample = x[rows if len(rows) <= 1024 else rows[:: len(rows) // 1024]]
        points = choose_points(sample, WAYS)
        if len(points) < 2:
            points = choose_points(x[rows], WAYS)
            if len(points) < 2:
                return rows
        d = self.space.distances(x[rows], points)
        to = d.argmin(axis=1)
        parts = [np.flatnonzero(to == j) for j in range(len(points))]
        if max(map(len, parts)) == len(rows):
            return rows
        held = [j for j, p in enumerate(parts) if len(p)]
        lows, highs = (np.stack([f(d[parts[j]], axis=0) for j in held], axis=1) for f in (np.min, np.max))
        return points, lows, highs, [self._grow(rows[parts[j]], x, depth + 1) for j in held]

    def leaves(self, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, rows) of the leaves to look at; ``far`` may shrink while the walk goes on. Close subtrees come first."""
        zero = np.zeros((len(anchors), 1))
        lifted, stack = np.concatenate([anchors, zero], axis=1), [(self.root, np.arange(len(anchors)), np.full(len(anchors), -np.inf))]
        while stack:
            node, who, bound = stack.pop()
            who = who[bound <= far[who]]
            if not len(who):
                continue
            if isinstance(node, np.ndarray):
                yield who, node
                continue
            points, lows, highs, below = node
            d = self.space.distances(lifted[who], points)
            stay = open_ways(d, near[who], far[who], lows, highs)
            closest = np.maximum(0, np.maximum(lows[None] - d[:, :, None], d[:, :, None] - highs[None]).max(axis=1)) - SLACK * (highs.max() + 1)
            for j in np.argsort(-np.where(stay, closest, np.inf).min(axis=0)):
                if stay[:, j].any():
                    stack.append((below[j], who[stay[:, j]], closest[stay[:, j], j]))


def best(x: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, a: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray,
         high: np.ndarray, k: int, same: bool, space: Space | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per window the first ``k`` rows of the anchor's label (or, unless ``same``, of others) with low <= score <= high: (window, rows, scores).

    ``space`` None: no tree, whole-number arithmetic.
    """
    keep: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, x.dtype)) for _ in range(len(a))]
    if space is not None:
        near, far = space.annulus(a, low, high)
        walk = Tree(space.lift(x), space).leaves(a, near, far)
    else:
        walk = ((np.arange(len(a)), np.arange(at, min(at + LEAF, len(x)))) for at in range(0, len(x), LEAF))
    low = low.copy()
    for who, rows in walk:
        s = a[who] @ x[rows].T
        fits = (s >= low[who, None]) & (s <= high[who, None]) & ((labels[rows][None, :] == label[who, None]) == same) & (uids[rows][None, :] != own[who, None])
        hit = np.flatnonzero(fits.any(axis=1))
        full = []
        for i in hit:
            c = np.flatnonzero(fits[i])
            if len(c) > 4 * k:  # the k-th score decides; ties at it stay in
                cut = -np.partition(-s[i, c], k - 1)[k - 1] if s.dtype != object else sorted(s[i, c], reverse=True)[k - 1]
                c = c[s[i, c] >= cut]
            at, scores = np.concatenate([keep[who[i]][0], rows[c]]), np.concatenate([keep[who[i]][1], s[i, c]])
            order = np.lexsort((uids[at], ids[at], -scores))[:k] if s.dtype != object else np.array(sorted(range(len(at)), key=lambda p: (-scores[p], ids[at[p]], uids[at[p]]))[:k])
            keep[who[i]] = at[order], scores[order]
            if len(order) == k:
                low[who[i]] = max(low[who[i]], scores[order[-1]])
                full.append(who[i])
        if full and space is not None:
            w = np.array(full)
            far[w] = np.minimum(far[w], space.annulus(a[w], low[w], high[w])[1])
    for i, (rows, scores) in enumerate(keep):
        if len(rows):
            yield i, rows, scores


def usable(vectors: DataFrame, key: str, vector: str, label: str, relabel: bool = True) -> DataFrame:
    """``uid, vec_id, label, v`` of the rows that take part: whole-number components, and a row number that tells repeated rows apart."""
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(~bad)
    moved = F.when((F.col("vec_id") % 7 == 0) & F.lit(relabel), F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    v = F.transform("x", lambda c: F.floor(c * 256).cast("double"))
    rows = rows.select("vec_id", moved.alias("label"), v.alias("v")).withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return rows.filter(F.col("sq") < WIDEST)


def _matrix(c: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = c.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


class Index:
    """All usable rows in blocks below the split points of the upper tree."""

    def __init__(self, rows: DataFrame, square: float, points: np.ndarray | None):
        self.spark, self.square, self.exact = rows.sparkSession, square, square < EXACT
        self.points = self.spark.sparkContext.broadcast(points)
        space = Space(square)

        shared, kept = self.points, pa.schema([("part", pa.int64()), ("point", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("m", pa.int64())])

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(space.distances(space.lift(np.stack(v.to_numpy())), shared.value).argmin(axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of this task's rows: for every point and part, the range of distances and the rows."""
            n = len(shared.value)
            lows, highs, rows = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n, np.int64)
            for batch in batches:
                part = batch.column(0).to_numpy()
                d = space.distances(space.lift(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)), shared.value)
                np.minimum.at(lows, part, d)
                np.maximum.at(highs, part, d)
                rows += np.bincount(part, minlength=n)
            at = np.repeat(np.flatnonzero(rows), n)
            point = np.tile(np.arange(n), len(at) // max(n, 1))
            yield pa.record_batch([pa.array(c) for c in (at, point, lows[at, point], highs[at, point], rows[at])], schema=kept)

        # without distances (whole-number arithmetic) there is one part, cut into blocks like any other
        placed = rows.withColumn("part", place("v") if self.exact else F.lit(0))
        self.rows = pin(placed.withColumn("uid", F.monotonically_increasing_id()))
        if self.exact:
            measured = self.rows.select("part", "v").mapInArrow(measure, "part long, point long, lo double, hi double, m long")
            ranges = measured.groupBy("part", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m")).collect()  # at most TOP squared
        else:
            ranges = [T.Row(part=0, point=0, lo=0.0, hi=0.0, m=self.rows.count())]
        self.parts = sorted({r.part for r in ranges})
        self.blocks = {r.part: -(-r.m // BLOCK) for r in ranges}
        self.lows, self.highs = np.zeros((2, 1 + max(r.point for r in ranges), len(self.parts)))
        column = {p: j for j, p in enumerate(self.parts)}
        for r in ranges:
            self.lows[r.point, column[r.part]], self.highs[r.point, column[r.part]] = r.lo, r.hi
        cuts = F.create_map(*[F.lit(x) for p in self.parts for x in (p, self.blocks[p])])
        self.held = self.rows.select("uid", "vec_id", "label", "v", "part", F.pmod(F.xxhash64("uid"), cuts[F.col("part")]).cast("int").alias("block"))

    def ask(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """First ``k`` of each window (``w, a, own, label, low, high``, and ``only``: the one part to look at, or ``skip``: the one not to):
        ``w, best`` with best an array of (far, vec_id, uid), far the negated score."""
        space = Space(self.square) if self.exact else None
        parts, blocks, lows, highs, shared = np.array(self.parts, np.int32), self.blocks, self.lows, self.highs, self.points

        @F.pandas_udf("array<int>")
        def ways(a: pd.Series, low: pd.Series, high: pd.Series, only: pd.Series, skip: pd.Series) -> pd.Series:
            if space is None:
                return pd.Series([parts if s < 0 else parts[:0] for s in skip])
            x = np.stack(a.to_numpy()) if len(a) else np.zeros((0, shared.value.shape[1] - 1))
            near, far = space.annulus(x, low.to_numpy(float), high.to_numpy(float))
            d = space.distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), shared.value)
            stay = open_ways(d, near, far, lows, highs)
            first = np.where(stay, d[:, parts], np.inf).argmin(axis=1)
            out = []
            for i in range(len(x)):
                p = parts[stay[i]]
                out.append(parts[first[i]:first[i] + 1] if only.iloc[i] else p[p != parts[first[i]]] if skip.iloc[i] >= 0 else p)
            return pd.Series(out)

        sent = windows.withColumn("to", F.explode(ways("a", "low", "high", "only", "skip")))
        sent = sent.withColumn("qb", F.explode(F.sequence(F.lit(0), F.create_map(*[F.lit(x) for p in self.parts for x in (p, blocks[p])])[F.col("to")].cast("int") - 1)))
        sent = pin(sent.select("w", "a", "own", F.col("label").alias("ql"), "low", "high", F.col("to").alias("qt"), "qb"))
        groups = sent.groupBy("qt", "qb").agg(F.ceil(F.count(F.lit(1)) / WINDOWS).cast("int").alias("g"))
        at = {(r.qt, r.qb): r.g for r in groups.collect()}  # one row per block of the index
        share = F.broadcast(self.spark.createDataFrame([(p, b, g) for (p, b), g in at.items()], "qt int, qb int, g int"))
        sent = sent.join(share, ["qt", "qb"]).withColumn("qg", F.pmod(F.xxhash64("w"), F.col("g")).cast("int")).drop("g")
        held = self.held.join(share.toDF("part", "block", "g"), ["part", "block"]).withColumn("bg", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        held = held.select(F.col("uid").alias("u"), F.col("vec_id").alias("i"), F.col("label").alias("l"), F.col("v").alias("x"), "part", "block", "bg")
        kind = np.float64 if self.exact else object

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            cols: list[list] = [[], [], [], []]
            if q.num_rows and x.num_rows:
                num = lambda t, c: t.column(c).to_numpy()
                whole = (lambda m: m) if kind is np.float64 else (lambda m: np.vectorize(int, otypes=[object])(m))
                limit = (lambda c: num(q, c).astype(float)) if kind is np.float64 else (lambda c: num(q, c).astype(object))
                w, ids, uids = num(q, "w"), num(x, "i"), num(x, "u")
                for at, rows, scores in best(whole(_matrix(x.column("x"), x.num_rows)), ids, uids, num(x, "l"), whole(_matrix(q.column("a"), q.num_rows)),
                                             num(q, "own"), num(q, "ql"), limit("low"), limit("high"), k, same, space):
                    for c, v in zip(cols, (np.full(len(rows), w[at]), ids[rows], uids[rows], np.array([int(s) for s in scores], np.int64)), strict=True):
                        c.append(v)
            return pa.table([np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols], names=["w", "vec_id", "uid", "score"])

        hits = sent.groupBy("qt", "qb", "qg").cogroup(held.groupBy("part", "block", "bg")).applyInArrow(meet, "w long, vec_id long, uid long, score long")
        # of every block at most k rows per window
        return hits.groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "uid"))), 1, k).alias("best"))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90,
         key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, relabel: bool = True) -> DataFrame:
    """Hard negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(256 * x); a score is a whole-number inner product. Anchors are rows with an id that ``every``
    divides; positives their best others of the same label; negatives the best rows of other labels with
    low_share * positive <= 100 * negative <= high_share * positive. Ties go to smaller ids.

    Split points are chosen from at most ``sample`` rows; every row is then assigned to its nearest
    point, and the ranges of distances between all points and parts cover all rows. An anchor first asks the
    part that is nearest to it; its best there bound what the others must hold. Parts are cut into
    blocks by a hash, so a vector that fills a third of the table spreads; each block grows a tree of its own with
    exact leaves. The result is exact.

    Rows with a null id, label or vector, or null or non-finite components take no part, and neither do vectors of another
    length than most (of equally common lengths, the longest) or with a squared length of 2^62 or more. Repeated ids are rows of their own, as
    anchors and as candidates; an anchor is never its own positive. Anchors without positives or negatives give no rows; no rows
    in, none out. Other columns and their names don't matter; equal rows tie by a row number.
    """
    rows = pin(usable(vectors, key, vector, label, relabel))
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("sq")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    result = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType()) for n in
                           ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    if not lengths or not lengths[0].d:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("v") == lengths[0].d)
    square = rows.agg(F.max("sq")).first()[0]
    points = None
    if square < EXACT:
        chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
        x = Space(square).lift(np.unique(np.stack([np.asarray(v) for v in chosen["v"]]), axis=0))
        points = choose_points(x, int(min(TOP, max(2, -(-lengths[0].n // BLOCK) * 4))))
    index = Index(rows.drop("sq"), square, points)
    anchors = index.rows.filter(F.col("vec_id") % every == 0)
    least, most, none = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long"), F.lit(-1)
    asked = anchors.select(F.col("uid").alias("w"), F.col("v").alias("a"), F.col("uid").alias("own"), "label", least.alias("low"), most.alias("high"))
    home = pin(index.ask(asked.withColumns({"only": F.lit(True), "skip": none}), positives, same=True))
    bound = F.when(F.size("best") == positives, -F.col("best")[positives - 1]["far"]).otherwise(least)
    seen = asked.join(home, "w", "left").withColumn("bound", F.coalesce(bound, least))
    rest = pin(index.ask(seen.select("w", "a", "own", "label", F.col("bound").alias("low"), "high", F.lit(False).alias("only"), F.lit(0).alias("skip")), positives, same=True)) \
        if index.exact else None
    # The part that came first with wide limits need not be the one that comes first with narrow ones, so a row may be met twice.
    merged = home if rest is None else home.unionByName(rest).groupBy("w").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, positives).alias("best"))
    pairs = pin(merged.select("w", F.explode("best").alias("p")).join(asked.select("w", "a", "own", "label"), "w").join(
        anchors.select(F.col("uid").alias("w"), F.col("vec_id").alias("anchor_id")), "w").select(
            "anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.far")).alias("positive_score"), "a", "own", "label"))
    ps = F.col("positive_score")
    tenth = lambda share, up: F.expr(f"CAST({'ceil' if up else 'floor'}(CAST(positive_score AS DECIMAL(38, 2)) * {share} / 100) AS LONG)")
    windows = pin(pairs.withColumns({"low": tenth(low_share, True), "high": tenth(high_share, False)}).filter("low <= high").withColumn("w", F.monotonically_increasing_id()))
    found = index.ask(windows.select("w", "a", "own", "label", "low", "high", F.lit(False).alias("only"), none.alias("skip")), negatives, same=False)
    named = windows.select("w", "anchor_id", "positive_id", ps)
    return found.join(named, "w").select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "hit")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("negative_id"), "positive_score", (-F.col("hit.far")).alias("negative_score"))
