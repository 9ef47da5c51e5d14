"""Language-model scores: a causal self-attention model over subword ids, beside a unigram base over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import BASE, MIX_A, MIX_B, body, mix, slices, text_buffers
from tickloom.llm.tokens import WordIds, WordTable
from tickloom.session import pin

#: Scored ids of a window, and ids of context in front of them.
STEP, BEHIND = 16, 8
#: Width; ids that are classes of their own; groups of the rarer ids by what they follow, and classes of each; ids that are inputs of their own (others share one per class).
WIDTH, SINGLE, GROUPS, BANDS, OWN = 16, 64, 8, 8, 4096
#: Each round learns from one window in ``SHARE`` of all training windows, in every task, and averages the tasks' weights;
#: as many rounds as that, so that every window is learnt from once.
SHARE = ROUNDS = 2
BATCH, RATE = 512, 0.02
#: Windows whose attention is computed at once: few, so that all it needs stays in a processor's cache. Classes are computed for
#: ``PART`` ids at once: products of these, ``WIDTH`` and the classes are below a million, as so small ones are not copied before they are multiplied.
BLOCK, PART = 64, 342
#: Frequent words whose counts are broadcast, at most; the others meet their counts by a join.
FREQUENT = 1 << 20
#: Words (not distinct) that are counted at once.
COUNTED = 1 << 21
#: Longer words are hashed one by one.
LONG = 64

# Distance of a key behind a query (0 for the query's own input), and what a query may not see.
_BEHIND = (np.arange(STEP)[:, None] + BEHIND) - np.arange(STEP + BEHIND)[None, :]
_ROW, _ONE = np.arange(PART), np.ones(SINGLE + GROUPS * BANDS, np.float32)
_DISTANCE, _SEEN = np.maximum(_BEHIND, 0), _BEHIND >= 0
#: Scores and logits are kept times this, as powers of 2 take half the time of powers of e.
_LOG2E = np.float32(1 / np.log(2))


def windows(lengths: np.ndarray, share: int = 1, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows' inputs (context, then one per scored id), whether they exist, and which scored ids do.

    Windows overlap by ``BEHIND``, so that every id of every text is scored once. Of all windows
    those are returned whose number plus ``first`` is divisible by ``share``.
    """
    starts, number = np.cumsum(lengths) - lengths, -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), number)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STEP
    if share > 1:
        kept = np.arange(-first % share, len(text), share)
        text, at = text[kept], at[kept]
    place = at[:, None] + np.arange(-BEHIND, STEP)
    there = (place >= 0) & (place < lengths[text][:, None])
    return np.clip(starts[text][:, None] + place, 0, max(int(lengths.sum()) - 1, 0)), there, there[:, BEHIND:]


def groups(table: np.ndarray) -> np.ndarray:
    """A group for each row of counts: rows that hold the same columns, by rounds of naive Bayes, the best of several starts."""
    table = np.sqrt(table)
    used, best, rng = np.flatnonzero(table.sum(axis=1)), None, np.random.default_rng(4)
    out = np.zeros(len(table), np.int64)
    if not len(used):
        return out
    table = table[used]
    weight = table.sum(axis=1) / table.sum()
    for _ in range(8):
        logs = np.log(table[rng.choice(len(table), GROUPS, p=weight)] + 0.1)
        for _ in range(16):
            logs -= np.log(np.exp(logs).sum(axis=1, keepdims=True))
            fit = table @ logs.T
            group = fit.argmax(axis=1)
            if best is None or fit.max(axis=1).sum() > best[0]:
                best = fit.max(axis=1).sum(), group
            logs = np.log(np.stack([table[group == g].sum(axis=0) for g in range(GROUPS)]) + 0.1)
    out[used] = best[1]
    return out


def marks(counts: np.ndarray) -> np.ndarray:
    """The rank of each id among the ``SINGLE`` most frequent ones, which is ``SINGLE`` for all others."""
    out = np.full(len(counts), SINGLE)
    order = np.argsort(-counts, kind="stable")[:SINGLE]
    out[order] = np.arange(len(order))
    return out


def before(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The id before each id; before a text's first comes its end."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(lengths) - lengths] = end
    return out


def following(ids: np.ndarray, lengths: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Cells (mark of the id before it, id)."""
    return mark[before(ids, lengths, len(mark) - 1)] * len(mark) + ids


@dataclass
class Tables:
    """The inputs' embeddings, what turns one into its query of keys' embeddings, and factors of the weights of a batch's pairs by their distance, 0 for keys behind the query."""

    e: np.ndarray
    turn: np.ndarray
    near: np.ndarray


@dataclass
class Seen:
    """A batch of windows after attention: embeddings of the inputs, the same turned above ones, and of queries alone; queries, unscaled weights, one over their sums in ``WIDTH`` columns, what they gather."""

    e: np.ndarray
    below: np.ndarray
    own: np.ndarray
    q: np.ndarray
    s: np.ndarray
    r: np.ndarray
    z: np.ndarray


def _wide(x: np.ndarray) -> np.ndarray:
    """Each number ``WIDTH`` times, side by side."""
    return x.repeat(WIDTH).reshape(-1, WIDTH)


def _fits(sums: np.ndarray, r: np.ndarray) -> bool:
    """Whether sums of exponentials, and one over them, are so far from overflow that nothing need be taken off the exponents."""
    return bool(sums @ sums < 1e36 and r @ r < 1e36)


@lru_cache(4)
def _room(classes: int, kind: np.dtype) -> tuple[np.ndarray, ...]:
    """Space for logits, for a summand of them, for scores, for their gradients, for turned embeddings above ones
    and for gradients by what a query gathers: used by one batch after the other."""
    return (*(np.empty((PART, classes), kind) for _ in "ab"), *(np.empty((BLOCK, STEP, STEP + BEHIND), kind) for _ in "ab"),
            np.ones((BLOCK, WIDTH + 1, STEP + BEHIND), kind), np.empty((BLOCK * STEP, WIDTH + 1), kind))


@dataclass
class Model:
    """An id's probability is that of its class by attention (frequent ids are classes of their own), times its share of the class.

    Both lean on what follows the id just before: the class by its input, the share by its mark (its rank, or its group).
    """

    entry: np.ndarray  # id -> input; the last input stands for what is not there
    kind: np.ndarray  # id -> class
    mark: np.ndarray  # id -> its mark for the share of the id behind it
    share: np.ndarray  # mark, id -> log share of its class
    bigram: np.ndarray  # input -> log probabilities of the next class
    weights: dict[str, np.ndarray]

    @classmethod
    def start(cls, counts: np.ndarray, group: np.ndarray) -> Model:
        """Classes, shares and inputs from the ids' counts and groups; weights that leave all to the class frequencies."""
        smooth, order = counts + 0.5, np.argsort(-counts, kind="stable")
        kind = np.empty(len(counts), np.int64)
        kind[order[:SINGLE]] = np.arange(len(order[:SINGLE]))
        for g in range(GROUPS):  # bands of equal mass
            own = order[SINGLE:][group[order[SINGLE:]] == g]
            mass = np.cumsum(smooth[own])
            kind[own] = SINGLE + g * BANDS + ((mass - smooth[own]) / mass[-1:] * BANDS).astype(int)
        kind = np.unique(kind, return_inverse=True)[1]
        totals = np.bincount(kind, smooth)
        entry = OWN + kind
        entry[order[:OWN]] = np.arange(len(order[:OWN]))
        inputs, classes, rng = OWN + len(totals) + 1, len(totals), np.random.default_rng(2)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(WIDTH)).astype(np.float32)
        weights = {"E": draw(inputs, WIDTH), "Q": draw(WIDTH, WIDTH), "K": draw(WIDTH, WIDTH), "V": draw(WIDTH, WIDTH),
                   "O": draw(WIDTH, classes) * np.float32(0.02), "R": np.zeros(STEP + BEHIND, np.float32)}
        base = np.log(totals / totals.sum()).astype(np.float32)
        mark = marks(counts)
        mark = np.where(mark < SINGLE, mark, SINGLE + group)
        share = np.tile(np.log(smooth / totals[kind]).astype(np.float32), (SINGLE + GROUPS, 1))
        return cls(entry, kind, mark, share, np.tile(base, (inputs, 1)), weights)

    def follow(self, pairs: np.ndarray, marked: np.ndarray) -> None:
        """Take in the counts of (input, next class) and (mark, next id), smoothed by the frequencies of classes and of ids in them."""
        base = np.exp(self.bigram[-1].astype(np.float64))
        self.bigram = np.log((pairs + 8.0 * base) / (pairs.sum(axis=1, keepdims=True) + 8.0)).astype(np.float32)
        for row, own in zip(self.share, marked, strict=True):
            row[:] = np.log((own + 20.0 * np.exp(row)) / (np.bincount(self.kind, own)[self.kind] + 20.0))

    def inputs(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per id the input that stands for the id before it; before a text's first comes its end, the last id of the vocabulary."""
        return self.entry[before(ids, lengths, len(self.entry) - 1)]

    def tables(self) -> Tables:
        """Tables of all inputs."""
        w = self.weights
        near = np.exp2(w["R"] * _LOG2E)[_DISTANCE] * _SEEN
        return Tables(w["E"], w["Q"] @ w["K"].T * _LOG2E, np.repeat(near[None], BLOCK, axis=0))

    def attend(self, x: np.ndarray, first: np.ndarray, t: Tables) -> Seen:
        """Attention in at most ``BLOCK`` windows; ``first``: those that begin a text.

        Queries, keys and values are products with the embeddings, which alone are gathered: a score is a query's turned
        embedding times a key's, and values are taken from the mean of embeddings. The result lasts until the next call.
        """
        room, e, first = _room(self.bigram.shape[1], t.e.dtype), t.e.take(x, 0, mode="clip"), first.nonzero()[0]
        s, below, own = room[2][:len(x)], room[4][:len(x)], e[:, BEHIND:].reshape(-1, WIDTH)
        below[:, :-1] = e.transpose(0, 2, 1)
        q = (own @ t.turn).reshape(len(x), STEP, WIDTH)
        for less in (False, True):
            np.matmul(q, below[:, :-1], out=s)
            if less:  # the largest of those that are seen
                s += np.log2(t.near[0], out=np.full_like(t.near[0], -np.inf), where=_SEEN)
                s[first, :, :BEHIND] = -np.inf
                s -= s.max(axis=2, keepdims=True)
            np.exp2(s, out=s)
            if not less:
                s *= t.near[:len(x)]
                if len(first):
                    s[first, :, :BEHIND] = 0
            sums = s.reshape(-1, STEP + BEHIND) @ _ONE[:STEP + BEHIND].astype(s.dtype, copy=False)
            r = 1 / sums
            if _fits(sums, r):
                break
        z, r = (s @ e).reshape(-1, WIDTH), _wide(r)
        z *= r
        return Seen(e, below, own, q, s, r, z)

    def odds(self, own: np.ndarray, h: np.ndarray, out: np.ndarray, direct: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Odds of the next class for at most ``PART`` ids, their sums, one over them, and the logits of ``kind``: a logit is from a row of ``direct`` for the own input, and ``h`` times ``out``.

        Logits are of base 2, so ``direct`` and ``out`` come times ``_LOG2E``. The odds last until the next call.
        """
        room, hit = _room(direct.shape[1], direct.dtype), None
        for less in (False, True):
            p = np.matmul(h, out, out=room[0][:len(h)])
            p += direct.take(own, 0, mode="clip", out=room[1][:len(h)])
            if less:
                p -= p.max(axis=1, keepdims=True)
            if kind is not None:
                hit = p[_ROW[:len(h)], kind]
            np.exp2(p, out=p)
            sums = p @ _ONE[:p.shape[1]].astype(p.dtype, copy=False)
            r = 1 / sums
            if _fits(sums, r):
                break
        return p, sums, r, hit

    def log10(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per id log10 of its probability given the ids before it in its window; every id is scored once."""
        if not len(ids):
            return np.zeros(0)
        out = self.share[self.mark[before(ids, lengths, len(self.mark) - 1)], ids] / np.log(10)
        place, there, scored = windows(lengths)
        inputs, kind, tables, w = self.inputs(ids, lengths), self.kind[ids], self.tables(), self.weights
        x, kind, begins = np.where(there, inputs[place], len(self.bigram) - 1), kind[place[:, BEHIND:]].ravel(), ~there[:, 0]
        each, direct, out_of = np.empty(scored.size, tables.e.dtype), (self.bigram + w["E"] @ w["O"]) * _LOG2E, w["V"] @ w["O"] * _LOG2E
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for b in range(0, len(x), BLOCK):
                z, own = self.attend(x[b:b + BLOCK], begins[b:b + BLOCK], tables).z, x[b:b + BLOCK, BEHIND:].ravel()
                for c in range(0, len(z), PART):
                    at = slice(b * STEP + c, b * STEP + min(c + PART, len(z)))
                    _, sums, _, hit = self.odds(own[c:c + PART], z[c:c + PART], out_of, direct, kind[at])
                    each[at] = hit - np.log2(sums)
        out += each[scored.ravel()] * np.log10(2)  # in the order of the ids
        return out

    def flat(self) -> np.ndarray:
        """The weights as rows of ``WIDTH`` numbers."""
        w = np.concatenate([a.ravel() for a in self.weights.values()])
        return np.pad(w, (0, -len(w) % WIDTH)).reshape(-1, WIDTH)

    def set_flat(self, rows: np.ndarray) -> None:
        w, at = rows.ravel().astype(np.float32), 0
        for n, a in self.weights.items():
            self.weights[n], at = w[at:at + a.size].reshape(a.shape), at + a.size


class Trainer:
    """Adam on batches of windows, for one task; ``seen`` windows so far."""

    def __init__(self, model: Model):
        self.model, self.seen, self.steps = model, 0, 0
        self.direct = model.bigram.astype(model.weights["E"].dtype) * _LOG2E
        self.m, self.v = ({n: np.zeros_like(a) for n, a in model.weights.items()} for _ in "mv")

    def learn(self, ids: np.ndarray, lengths: np.ndarray, share: int, first: int) -> None:
        place, there, scored = windows(lengths, share, first)
        if not len(place):
            return
        x, kind = np.where(there, self.model.inputs(ids, lengths)[place], len(self.model.bigram) - 1), self.model.kind[ids][place[:, BEHIND:]]
        mixed = np.random.default_rng(len(place)).permutation(len(place))
        for b in np.array_split(mixed, -(-len(mixed) // BATCH)):
            self.step(x[b], ~there[b, 0], kind[b], scored[b])
        self.seen += len(place)

    def step(self, x: np.ndarray, first: np.ndarray, kind: np.ndarray, scored: np.ndarray) -> None:
        w, tables, classes = self.model.weights, self.model.tables(), self.direct.shape[1]
        room, both, into, back, turned = _room(classes, tables.e.dtype), w["K"] @ w["Q"].T, w["O"] * _LOG2E, np.ascontiguousarray(w["O"].T), np.ascontiguousarray(w["V"].T)
        each, kind = (scored / scored.sum()).astype(tables.e.dtype).ravel(), kind.ravel()
        g, pair, moved, dr = {n: np.zeros_like(w[n]) for n in "OV"}, np.zeros_like(w["Q"]), np.empty((*x.shape, WIDTH), tables.e.dtype), 0
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for b in range(0, len(x), BLOCK):
                inputs = x[b:b + BLOCK]
                n, t, own = len(inputs), self.model.attend(inputs, first[b:b + BLOCK], tables), inputs[:, BEHIND:].ravel()
                h, ds, y, dh = t.z @ w["V"], room[3][:n], room[5][:n * STEP], np.empty_like(t.z)
                h += t.own
                for c in range(0, len(h), PART):
                    part, at = slice(c, min(c + PART, len(h))), slice(b * STEP + c, b * STEP + min(c + PART, len(h)))
                    p, sums, r, _ = self.model.odds(own[part], h[part], into, self.direct)
                    flat, hit = p.reshape(-1), _ROW[:len(p)] * classes + kind[at]
                    flat[hit] = flat.take(hit) - sums  # times the row's weight this is the gradient
                    weight = _wide(each[at] * r)
                    np.matmul(p, back, out=dh[part])
                    dh[part] *= weight
                    weight *= h[part]
                    g["O"] += weight.T @ p
                g["V"] += t.z.T @ dh
                v = dh @ turned
                v *= t.r
                y[:, :-1] = v  # with the mean over a query's keys, which the ones below the embeddings take off
                v *= t.z
                np.negative(v @ _ONE[:WIDTH].astype(v.dtype, copy=False), out=y[:, -1])
                y = y.reshape(n, STEP, WIDTH + 1)
                np.matmul(y, t.below, out=ds)
                ds *= t.s
                u = (ds @ t.e).reshape(-1, WIDTH)
                pair += t.own.T @ u
                dr = dr + np.add.reduce(ds.reshape(n, -1), axis=0)
                part = np.matmul(ds.transpose(0, 2, 1), np.divide(t.q, _LOG2E, out=t.q), out=moved[b:b + BLOCK])
                part += t.s.transpose(0, 2, 1) @ y[:, :, :-1]
                dh += u @ both
                part[:, BEHIND:] += dh.reshape(n, STEP, WIDTH)
        g["Q"], g["K"] = pair @ w["K"], pair.T @ w["Q"]
        g["R"] = np.bincount(_DISTANCE.ravel(), dr.ravel(), minlength=len(w["R"])).astype(np.float32)
        inputs = x.ravel().astype(np.uint16 if len(w["E"]) <= 1 << 16 else np.int64)
        order = np.argsort(inputs, kind="stable")
        inputs = inputs[order]
        begin = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
        pairs = moved.reshape(-1, WIDTH).view(np.result_type(moved, 1j))  # two numbers are added as one complex number, in half the time
        at, de = inputs[begin], np.add.reduceat(pairs.take(order, 0), begin, axis=0).view(moved.dtype)
        self.steps += 1
        a, b = 1 / (1 - 0.9 ** self.steps), 1 / (1 - 0.99 ** self.steps)
        for n, d in (*g.items(), ("E", de)):  # only embeddings that occur are moved
            i = at if n == "E" else slice(None)
            m, v = self.m[n][i], self.v[n][i]
            m *= 0.9
            m += 0.1 * d
            d = d * d
            d *= 0.01
            v *= 0.99
            v += d
            self.m[n][i], self.v[n][i] = m, v
            np.sqrt(np.multiply(v, b, out=d), out=d)
            d += 1e-7
            np.divide(m, d, out=d)
            d *= a * (RATE / 4 if n != "E" else RATE)
            w[n][i] -= d


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learnt from: remainder 2 of the id's crc32 by 7; a null id is read as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, parted by ASCII white space) by eight bytes at a time, each text's number of words, and where each word begins and ends."""
    gap = (data == 32) | ((data - np.uint8(9)) < 5)
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[1:] = True, gap
    edge[offsets[:-1]] = True
    first = np.flatnonzero(edge[:-1] & ~gap)
    edge[:-1], edge[-1] = gap, True
    edge[offsets[:-1]] = True
    end = np.flatnonzero(edge[1:] & ~gap) + 1
    n, raw = end - first, data.tobytes().lower() + bytes(8)
    eight = np.ndarray(len(data) + 1, np.uint64, raw, strides=(1,))
    h = mix((eight[first] & _MASKS[np.minimum(n, 8)]) + n.astype(np.uint64) * BASE)
    more, at = np.flatnonzero(n > 8), 8
    while len(more) and at < LONG:
        h[more] = mix(h[more] * MIX_B + (eight[first[more] + at] & _MASKS[np.minimum(n[more] - at, 8)]) + MIX_A)
        at += 8
        more = more[n[more] > at]
    for i in more.tolist():
        h[i] = int.from_bytes(blake2b(raw[first[i]:end[i]], digest_size=8).digest(), "little")
    return h.view(np.int64), np.diff(np.searchsorted(first, offsets)), first, end


def _hashes(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words_of`` a column, in blocks that stay in a processor's cache."""
    found, base = [], 0
    for block in slices(iter([part.select([at])]), part.schema.names[at], 1 << 18):
        data, offsets = text_buffers(block.column(0))
        h, n, first, end = words_of(data, offsets)
        found.append((h, n, first + base, end + base))
        base += len(data)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, c``: hash and count of every word of the training texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            distinct, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n)], ["h", "c"])
        held: list[np.ndarray] = []
        for part in slices(batches):
            held.append(_hashes(part, 0)[0])
            if sum(map(len, held)) >= COUNTED:
                yield counted()
                held = []
        if held:
            yield counted()
    out = docs.filter(~held_out()).select(body().alias("text")).mapInArrow(task, "h long, c long")
    return out.groupBy("h").agg(F.sum("c").alias("c"))


def distinct_words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, a place of each, and the number of its distinct one for each hash."""
    order = np.argsort(h)  # any place does, so it need not be stable, which would take several times as long
    ranked = h[order]
    begin = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), ranked[1:] != ranked[:-1]]))
    inverse = np.empty(len(h), np.int32)
    inverse[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(h))))
    return ranked[begin], order[begin], inverse


def encode_texts(column: pa.Array, table: WordTable, counts: np.ndarray, first: np.ndarray, end: np.ndarray, distinct: np.ndarray, place: np.ndarray,
                 inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, A-Z lower-cased, each with its end, and the length of each.

    ``counts`` are the words of each text, ``first`` and ``end`` where each word begins and ends in the column's bytes, ``distinct`` the different
    hashes of words, ``place`` the number of a word for each of these, ``inverse`` that of its distinct one for each word.
    """
    def words(which: np.ndarray) -> list[bytes]:
        data, at = text_buffers(column)[0].tobytes().lower(), place[which]
        return [data[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]

    begin, size, flat = table.find(distinct, words)
    begin, size = np.append(begin, 0), np.append(size, np.int32(1))
    word = np.full(len(inverse) + len(counts), len(distinct), np.int32)  # with an end behind each text
    word[np.arange(len(inverse)) + np.repeat(np.arange(len(counts)), counts)] = inverse
    n = size[word]
    after = np.cumsum(n)
    lengths = np.diff(after[np.cumsum(counts) + np.arange(len(counts))], prepend=0)
    return flat.take(np.repeat(begin[word] - after + n, n) + np.arange(n.sum())), lengths


def _ids(part: pa.RecordBatch, at: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(part.column(at))
    return data.view(kind).astype(np.int64), np.diff(offsets) // np.dtype(kind).itemsize


def _tally(texts: DataFrame, size: int, cells, kind: type) -> np.ndarray:
    """Sum ``cells(ids, lengths)`` over all rows; one row per cell that is not zero comes to the driver, at most ``size``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in slices(batches, "ids", limit=4 << 20):
            found = cells(*_ids(part, 0, kind))
            if len(found) < size:  # rather than a whole table of counts for each slice
                np.add.at(total, found, np.int64(1))
            else:
                total += np.bincount(found, minlength=size)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(total[i])], ["i", "n"])
    out = np.zeros(size)
    found = texts.select("ids").mapInArrow(task, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def train(texts: DataFrame, size: int, kind: type, share: int = SHARE, rounds: int = ROUNDS) -> Model:
    """Fit a model on the ``ids`` of all rows: counts of ids and of pairs and weights over all of them.

    In every round each task starts from the same weights and learns from one window in ``share`` of
    its rows, another one in each round, so that ``share`` rounds take every window once; the weights
    are averaged by windows, as rows that Spark sums.
    """
    sc = texts.sparkSession.sparkContext
    counts = _tally(texts, size, lambda ids, lengths: ids, kind)
    ranks = sc.broadcast(marks(counts))
    ranked = _tally(texts, size * (SINGLE + 1), lambda ids, lengths: following(ids, lengths, ranks.value), kind)
    model = Model.start(counts, groups(ranked.reshape(-1, size)[:SINGLE].T))
    classes, shared = model.bigram.shape[1], sc.broadcast(model)
    both = _tally(texts, model.bigram.size + model.share.size, lambda ids, lengths: np.concatenate([
        shared.value.inputs(ids, lengths) * classes + shared.value.kind[ids], shared.value.bigram.size + following(ids, lengths, shared.value.mark)]), kind)
    model.follow(both[:model.bigram.size].reshape(-1, classes), both[model.bigram.size:].reshape(-1, size))

    def rounded(shared, number: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base = shared.value
            trainer, at = Trainer(replace(base, weights={n: a.copy() for n, a in base.weights.items()})), number
            for part in slices(batches, "ids", limit=1 << 20):
                ids, lengths = _ids(part, 0, kind)
                trainer.learn(ids, lengths, share, at)
                at += int((-(-lengths // STEP)).sum())
            if trainer.seen:
                rows = trainer.model.flat().astype(np.float64) * trainer.seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), trainer.seen)), *[pa.array(c) for c in np.ascontiguousarray(rows.T)]], names)
        return task

    names = ["i", "n", *[f"w{c}" for c in range(WIDTH)]]
    for number in range(rounds):
        schema = "i long, n long, " + ", ".join(f"{c} double" for c in names[2:])
        summed = texts.select("ids").mapInArrow(rounded(sc.broadcast(model), number), schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas()
        if len(summed):
            summed = summed.sort_values("i")
            model.set_flat(summed[names[2:]].to_numpy() / summed[["n"]].to_numpy())
    return model


def score(docs: DataFrame, path: str, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids``.

    ``score`` is the attention model's log10 probability of the text's ``n_ids`` subword ids (A-Z
    lower-cased) and its end; ``base_score`` that of its words and one end by smoothed counts.
    All counts come from all texts but the held-out ones, and so do the attention weights: from one window in
    ``share`` of them in each of ``rounds``, by default from every window once. Null text is empty: the end alone. A null id is read
    as an empty one and learnt from. Repeated rows are counted and returned as often as they occur.
    Very long texts, with or without white space, are scored whole, in windows. Without training
    texts every word is unknown and all ids are alike. Other columns are not read, so their names are free.
    Of word counts, at most ``FREQUENT`` are broadcast; the others meet their words by a join, which
    Spark can split where a word of held-out texts alone is frequent.
    """
    sc, size = docs.sparkSession.sparkContext, WordIds(path).size
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    counts = pin(word_counts(docs))
    ends = docs.filter(~held_out()).count()
    by_size = sorted(((r.b, r.n) for r in counts.groupBy(F.floor(F.log2("c")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, held = 2, 0  # a word that occurs once is never frequent
    for b, number in by_size:
        held += number
        if held > FREQUENT:
            least = max(least, 1 << (b + 1))
            break
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_train, distinct = (total[0] or 0) + ends, total[1] + (ends > 0)
    often = counts.filter(F.col("c") >= least).toArrow().sort_by("h")
    frequent = sc.broadcast((often.column("h").to_numpy(), often.column("c").to_numpy()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        table, row, part_id = WordTable.of(path), 0, TaskContext.get().partitionId()
        logs = np.log10(count + 1.0)
        for part in slices(batches, limit=4 << 20):
            h, n, first, end = _hashes(part, 1)
            distinct, place, inverse = distinct_words(h)
            text = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
            hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
            own = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(distinct))
            ids, lengths = encode_texts(part.column(1), table, n, first, end, distinct, place, inverse)
            met = hit[inverse]
            seen = np.bincount(text[met], minlength=len(n))
            base = np.bincount(text, own[inverse], minlength=len(n)) if len(h) else np.zeros(len(n))
            rare = np.concatenate([[0], np.cumsum(n - seen)]).astype(np.int32)
            places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64) * ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array((part_id << 40) + row + np.arange(len(n))), part.column(0), part.column(2), pa.array(n.astype(np.int64)),
                 pa.array(seen.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(pa.array(rare), pa.array(h[~met])),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids)])],
                ["row", "doc_id", "held_out", "n", "seen", "base", "rare", "ids"])
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), held_out().alias("held_out"))
    coded = pin(rows.mapInArrow(encode, "row long, doc_id long, held_out boolean, n long, seen long, base double, rare array<long>, ids binary"))
    shared = sc.broadcast(train(coded.filter(~F.col("held_out")), size, kind, share, rounds))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", limit=1 << 20):
            ids, lengths = _ids(part, part.num_columns - 1, kind)
            sums = np.concatenate([[0.0], np.cumsum(shared.value.log10(ids, lengths))])
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lengths), pa.array(sums[ends] - sums[ends - lengths])],
                                             [*part.schema.names[:-1], "n_ids", "score"])

    scored = coded.select("row", "doc_id", "held_out", "n", "seen", "base", "ids").mapInArrow(
        task, "row long, doc_id long, held_out boolean, n long, seen long, base double, n_ids long, score double")
    found = (coded.select("row", F.explode("rare").alias("h")).join(counts.filter(F.col("c") < least), "h")
             .groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("c").alias("met")))
    n_tokens = F.col("n") + 1
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - n_tokens * F.lit(float(np.log10(n_train + distinct + 1.0)))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("seen") + F.coalesce("met", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_ids")
