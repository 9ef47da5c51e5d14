"""Spelling variants: words one edit apart, found in tries of letter-group counts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, slices, text_buffers
from tickloom.session import pin, small_side

LEAST_LETTERS, LEAST_COUNT, VARIANT = 5, 3, 97
#: Whole runs of letters (lower-cased before) that are long enough; shorter ones can't become words.
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
#: Letter groups, that is levels of the trie; a node with this many words or fewer is a leaf; words that a task keeps before it hands on counts.
GROUPS, LEAF, HELD = 24, 64, 200_000
#: Words of a block at most, each with a trie of its own, and queries that meet it at once; words that a subtree should have; counts beyond CLIP are one branch there.
BLOCK, QUERIES, SUBTREE, CLIP = 32_768, 131_072, 4096, 5
#: Longer words are compared letter by letter instead of in a matrix; numbers in an array of a step.
MATRIX, CELLS = 32, 1 << 20
#: Higher counts of a group are this one: that never parts words one edit apart, and squares stay exact in single precision.
MOST = 127


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the runs of letters of all texts, some of them with a letter dropped, that occur often enough.

    Tasks count as they read and hand on partial counts, so that a word in a third of all texts is
    a few rows in the shuffle.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for b in slices(batches, "t"):
            data, offsets = text_buffers(b.column(1))
            lower = data.tobytes().lower()  # of bytes: A-Z only
            for i, a, e in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                s = lower[a:e].decode()
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                runs = RUN.findall(s) if len(s) < 1 << 20 else (m[0] for m in RUN.finditer(s))
                for w, n in Counter(runs).items():
                    h = zlib.crc32(w.encode(), start)
                    if not h % VARIANT:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < LEAST_LETTERS:
                            continue
                    held[w] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    texts = docs.select(F.col(key).cast("string").alias("i"), body(text).alias("t"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of every code point: letters dealt out by how many they are, the most common ones first (at most 90 letters)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in slices(batches, "word"):
            total += np.bincount(np.frombuffer("".join(b.column(0).to_pylist()).encode("latin-1"), np.uint8), minlength=256)
        yield pa.record_batch([pa.array(np.arange(256)), pa.array(total)], names=["letter", "n"])

    rows = words.select("word").mapInArrow(count, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).filter("n > 0").collect()
    table = np.zeros(256, np.uint8)
    for at, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.letter))):
        table[r.letter] = at % groups if at // groups % 2 == 0 else groups - 1 - at % groups
    return table


class Words:
    """Words as arrays: letters, lengths, counts by group, and the letters left- and right-aligned in matrices."""

    def __init__(self, words: list[str], table: np.ndarray, groups: int):
        self.words = words
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(len(words)), self.size)
        counts = np.bincount(row * groups + table[codes], minlength=len(words) * groups).reshape(-1, groups)
        self.vec = np.minimum(counts, MOST).astype(np.float32)
        ends = np.cumsum(self.size)
        place = np.arange(len(codes)) - np.repeat(ends - self.size, self.size)
        fits = self.size[row] <= MATRIX
        self.left, self.right = np.zeros((2, len(words), MATRIX), np.uint8)
        self.left[row[fits], place[fits]] = codes[fits]
        self.right[row[fits], MATRIX - self.size[row[fits]] + place[fits]] = codes[fits]


def one_edit(a: str, b: str) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[same + 1:] == b[same + (len(a) == len(b)):]


def verified(q: Words, w: Words, qi: np.ndarray, wi: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart."""
    a, b = q.size[qi], w.size[wi]
    ok = np.abs(a - b) <= 1
    long = ok & (np.maximum(a, b) > MATRIX)
    ok &= ~long
    at = np.flatnonzero(ok)
    differs = q.left[qi[at]] != w.left[wi[at]]
    level = a[at] == b[at]
    good = level & (differs.sum(axis=1) == 1)
    at2 = np.flatnonzero(~level)  # one is longer: what agrees from the left and from the right must cover the shorter
    left = differs[at2].argmax(axis=1)
    right = (q.right[qi[at[at2]]] != w.right[wi[at[at2]]])[:, ::-1].argmax(axis=1)
    good[at2] = left + right >= np.minimum(a, b)[at[at2]]
    ok[at] = good
    for p in np.flatnonzero(long):
        ok[p] = one_edit(q.words[qi[p]], w.words[wi[p]])
    return ok


def search(q: Words, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, word) one edit apart, by a depth-first walk over the words' trie with all queries at once.

    A level of the trie is the count of one letter group. A query enters a branch whose count is its
    own, or one more while its surplus of one is unspent, or one less while its deficit is. At a leaf both
    budgets hold where the counts' squared distance is at most two and the lengths differ by at most
    one; those words are verified letter by letter.
    """
    order = np.lexsort(w.vec.T[::-1])
    trie, groups = w.vec[order], w.vec.shape[1]
    far_q, far_w = (q.vec ** 2).sum(axis=1) - 2.5, (trie ** 2).sum(axis=1)
    start = np.arange(len(q.words))
    stack = [(0, len(order), 0, start, np.ones(len(start), bool), np.ones(len(start), bool))]
    while stack:
        lo, hi, level, who, more, less = stack.pop()
        if hi - lo <= LEAF or level == groups:
            step = max(1, CELLS // min(hi - lo, 4096))
            for x in range(lo, hi, 4096):
                here = 2 * trie[x:min(hi, x + 4096)].T
                for at in range(0, len(who), step):
                    part = who[at:at + step]
                    apart = q.vec[part] @ here
                    apart -= far_q[part, None]
                    i, j = np.nonzero(apart >= far_w[x:min(hi, x + 4096)])
                    if len(i):
                        qi, wi = part[i], order[x + j]
                        keep = verified(q, w, qi, wi)
                        yield qi[keep], wi[keep]
            continue
        column, own = trie[lo:hi, level], q.vec[who, level]
        edges = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step = column[a] - own
            go = np.flatnonzero((step == 0) | (step == 1) & more | (step == -1) & less)
            if len(go):
                stack.append((lo + a, lo + b, level + 1, who[go], more[go] & (step[go] != 1), less[go] & (step[go] != -1)))


def _top(word: Column, table: np.ndarray, levels: int) -> list[Column]:
    """Counts of the first letter groups, clipped, so that words fall into a bounded number of subtrees."""
    out = []
    for g in range(levels):
        letters = "".join(re.escape(chr(c)) for c in np.flatnonzero(table == g) if chr(c).isalpha() or c in (0xD7, 0xF7))
        out.append(F.least(F.length(F.regexp_replace(word, f"[^{letters}]", "")) if letters else F.lit(0), F.lit(CLIP)))
    return out


def _near_tops(levels: int) -> Column:
    """All subtrees that the budget of one surplus and one deficit reaches from that of ``top`` (an array)."""
    moves = [(0,) * levels]
    for g in range(levels):
        for h in range(-1, levels):
            if g != h:
                for sign in ((1, -1) if h < 0 else (1,)):
                    m = [0] * levels
                    m[g] += sign
                    if h >= 0:
                        m[h] -= 1
                    moves.append(tuple(m))
    return F.array(*[F.array(*[(F.col("top")[g] + F.lit(m[g])) for g in range(levels)]) for m in moves])


def near_words(words: DataFrame, groups: int = GROUPS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``word, n, n_near, best`` for ``words`` (word, n; each word once): how many are one edit away, and (-n, word) of the best of them.

    The upper levels of the trie are spread over the cluster: words with the same clipped counts of the first groups are a
    subtree, and as many levels are taken as the number of words asks for. A subtree is cut into
    blocks of about ``block`` words, and the words that can reach it into parts of ``queries``; each pair of
    block and part is one small group, so that no common vector fills a task. Only counts and
    the best word leave a group, never its pairs.
    """
    words = pin(words)
    total = words.count()
    table = letter_groups(words, groups)
    levels = 1
    while 3 ** levels * SUBTREE < total and levels < groups:
        levels += 1
    placed = words.withColumn("top", F.array(*_top(F.col("word"), table, levels)))
    sizes = pin(placed.groupBy("top").agg(F.count(F.lit(1)).alias("m")))
    reach = sizes.select("top", "m", F.explode(_near_tops(levels)).alias("to")).join(
        sizes.select(F.col("top").alias("to"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "to")
    # of a subtree: the parts of the words that come to it; of a word's subtree: where its words go
    parts = reach.groupBy("to").agg(F.ceil(F.sum("m") / queries).cast("int").alias("parts"), F.max("blocks").alias("blocks"))
    ways = reach.select("top", "to").join(parts, "to").groupBy("top").agg(F.collect_list(F.struct("to", "blocks", "parts")).alias("ways"))  # as many as moves
    asked = placed.select("word", "top").join(small_side(ways, limit=50_000), "top").select("word", F.explode("ways").alias("w"))
    part = lambda c: F.pmod(F.xxhash64("word", F.lit("part")), c).cast("int")
    asked = asked.select("word", F.col("w.to").alias("qt"), part(F.col("w.parts")).alias("qp"), F.explode(F.sequence(F.lit(0), F.col("w.blocks") - 1)).alias("qb"))
    held = placed.join(small_side(parts.withColumnRenamed("to", "top"), limit=50_000), "top").select(
        F.col("word").alias("term"), "n", F.col("top").alias("ht"), F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))

    def meet(q: pa.Table, w: pa.Table) -> pa.Table:
        asking, there = q.column("word").to_pylist(), sorted(zip((-n for n in w.column("n").to_pylist()), w.column("term").to_pylist(), strict=True))
        near, best = np.zeros(len(asking), np.int64), np.full(len(asking), len(there), np.int64)
        if asking and there:
            index = Words([x for _, x in there], table, groups)
            for at in range(0, len(asking), 32_768):
                own = Words(asking[at:at + 32_768], table, groups)
                for qi, wi in search(own, index):
                    near[at:at + 32_768] += np.bincount(qi, minlength=len(own.words))
                    np.minimum.at(best, at + qi, wi)
        hit = np.flatnonzero(near)
        return pa.table([pa.array([asking[i] for i in hit], pa.string()), pa.array(near[hit]), pa.array([-there[best[i]][0] for i in hit], pa.int64()),
                         pa.array([there[best[i]][1] for i in hit], pa.string())], names=["word", "k", "best_n", "best_word"])

    found = asked.groupBy("qt", "qb", "qp").cogroup(held.groupBy("ht", "b", "p")).applyInArrow(meet, "word string, k long, best_n long, best_word string")
    best = F.struct((-F.col("best_n")).alias("far"), F.col("best_word").alias("word"))
    both = found.select("word", F.lit(None).cast("long").alias("n"), "k", best.alias("best")).unionByName(words.select("word", "n"), allowMissingColumns=True)
    return both.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: where following the forms ends. Each round doubles the way that is followed.

    A form is at least twice as common as its word, so ways are short and have no rings.
    """
    at = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = pin(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each word with its form: ``word, form, root, n, n_near, form_n``.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where 97 divides
    the crc32 of ``<id>:<run>`` one letter is dropped. Words of five letters or more and three
    occurrences or more stay. A word's form is the most common word one edit away (ties: first in code-point order), if that
    is twice as common or more; the root is where forms end. Null texts have no words, a null id counts as
    an empty one; repeated rows count each time; a very long text is read run by run, a very long run is a word like others.
    No words, no rows. Other columns and their names don't matter.
    """
    near = pin(near_words(counted_words(docs, key, text)))
    kept = F.col("best").isNotNull() & (-F.col("best.far") >= 2 * F.col("n"))
    rows = near.select("word", "n", "n_near", F.when(kept, F.col("best.word")).alias("form"), F.when(kept, -F.col("best.far")).alias("form_n"))
    ends = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
