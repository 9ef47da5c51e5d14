"""Secret scans: fixed patterns, and probabilistic automata inferred from what they label."""

from __future__ import annotations

import ctypes
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, slices
from tickloom.session import pin

# The base patterns, and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex")
#: Candidates: runs that a credential may consist of, as long as the shortest kind, and what begins or ends at a mark inside one.
RUN, MARK = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(LEAST.values())), re.compile(r"[=/.]")
#: Labelled values of a kind that are fitted, at most; confidence of a merge; share of labelled values below the score that is asked for.
LABELLED, ALPHA, BELOW = 3000, 0.05, 0.02
#: Characters of the longest value that an automaton is fitted on.
LONGEST = 256
#: Characters at the front of a value that keep their identity; later ones count by class.
PREFIX = 4
#: Characters of the texts that are held as Python strings at a time.
SLICE = 1 << 20


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """``(start, kind, end, value)`` of the fixed patterns, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in RUN.finditer(text):  # every match that is long enough lies in such a run
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text, *run.span()) if m.end() - m.start() >= LEAST[kind]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def symbols(value: str) -> str:
    """The value as symbols: the first characters themselves, later ones d, h, l, H, L for digits and letters, else themselves."""
    def of(c: str) -> str:
        if c.isdigit():
            return "d"
        if c.isalpha():
            return ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "L")
        return c
    return "".join(c if i < PREFIX and not c.isdigit() and c not in "abcdef" else of(c) for i, c in enumerate(value))


class Automaton:
    """A probabilistic automaton: a prefix tree whose compatible states are merged, red and blue."""

    def __init__(self, values: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[defaultdict] = [defaultdict(int)]  # visits by symbol; "" ends
        for value in sorted(values):
            at = 0
            for c in symbols(value):
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            self.count[at][""] += 1
        self._merge()
        self.logs = [{c: math.log2(n / total) for c, n in counts.items()} if (total := sum(counts.values())) else {} for counts in self.count]
        scores = sorted(self.score(v) for v in values)
        self.least = scores[int(BELOW * len(scores))]

    def _alike(self, a: int, b: int) -> bool:
        """Whether no frequency below the two states differs more than the Hoeffding bound allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound for c in {*self.count[a], *self.count[b]}):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[b] if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = next(((r, c) for r in red for c in sorted(self.next[r]) if self.next[r][c] not in seen), None)
            if blue is None:
                return
            state = self.next[blue[0]][blue[1]]
            twin = next((r for r in red if self._alike(r, state)), None)
            if twin is None:
                red.append(state)
                seen.add(state)
            else:
                self.next[blue[0]][blue[1]] = twin
                self._fold(twin, state)

    def score(self, value: str) -> float:
        """Mean log2 likelihood of a symbol, the end counted as one; minus infinity for what the automaton cannot make."""
        return self.tail(value, 0, symbols("." * PREFIX + value)[PREFIX:], {})

    def tail(self, value: str, start: int, classes: str, memo: dict[tuple[int, int], float]) -> float:
        """The score of ``value[start:]``. ``classes`` are the symbols of later characters; ``memo`` keeps what follows a
        state at a place, so that all tails of a value take one pass for each state."""
        at, total, place, path = 0, 0.0, start, []
        for c in symbols(value[start:start + PREFIX]):
            if c not in self.logs[at]:
                return -math.inf
            total += self.logs[at][c]
            at = self.next[at][c]
            place += 1
        while (rest := memo.get((at, place))) is None:
            c = classes[place:place + 1]  # "" at the end
            if not c or c not in self.logs[at]:
                rest = -math.inf if c else self.logs[at].get("", -math.inf)
                break
            path.append((at, place, self.logs[at][c]))
            at, place = self.next[at][c], place + 1
        for state, before, log in reversed(path):
            rest += log
            memo[state, before] = rest
        return (total + rest) / (len(value) - start + 1)


def _found(value: str, automata: dict[str, Automaton], whole: bool = False) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of what the automata score as high as their own examples, from the left: the value, what is behind
    a mark in it, and the parts between marks. ``whole``: only the value itself."""
    least = min((LEAST[k] for k in automata), default=0)
    classes, memos, out, done = symbols("." * PREFIX + value)[PREFIX:], {k: {} for k in automata}, [], 0
    marks = [] if whole else [m.start() for m in MARK.finditer(value)]
    for start, stop in zip([0, *(m + 1 for m in marks)], [*marks, len(value)], strict=True):
        if start < done or len(value) - start < least:
            continue
        over = [(a.tail(value, start, classes, memos[k]) - a.least, len(value), k) for k, a in automata.items() if len(value) - start >= LEAST[k]]
        if max(over, default=(-1,))[0] < 0 and stop < len(value) and not whole:
            over = [(a.score(value[start:stop]) - a.least, stop, k) for k, a in automata.items() if stop - start >= LEAST[k]]
        margin, end, kind = max(over, key=lambda o: o[0], default=(-1, 0, ""))
        if margin >= 0:
            out.append((start, end, kind))
            done = end
    return out


def all_spans(text: str, automata: dict[str, Automaton]) -> list[tuple[int, str, int, str]]:
    """The base spans, and candidates that an automaton scores as high as its own examples, named like_<kind>.

    Candidates are whole runs, what stands behind or between marks in them, and what base spans leave of a run. A run
    with a base span that is no assignment is also scored as a whole.
    """
    found = base_spans(text)
    more, first = [], 0
    ordered = sorted(((s, e, k) for s, k, e, _ in found), key=lambda s: s[1])
    for run in RUN.finditer(text):
        begin, end = run.start(), run.start() + len(run[0].rstrip("."))
        while first < len(ordered) and ordered[first][1] <= begin:
            first += 1
        inside, n = [], first
        while n < len(ordered) and ordered[n][1] <= run.end():  # no base span goes on behind the run it ends in
            inside.append(ordered[n])
            n += 1
        holds = [(begin, end)]
        if inside:
            if all(k != "assign" for _, _, k in inside) and (begin, end) not in [(s, e) for s, e, _ in inside]:
                hits = _found(text[begin:end], automata, whole=True)
                if hits:
                    more.append((begin, f"like_{hits[0][2]}", end, text[begin:end]))
                    continue
            holds, at = [], begin
            for s, e, _ in sorted(inside):
                holds.append((at, s))
                at = max(at, e)
            holds.append((at, end))
        for a, b in holds:
            if b > a:
                more += [(a + s, f"like_{kind}", a + e, text[a + s:a + e]) for s, e, kind in _found(text[a:b], automata)]
    return sorted(found + more, key=lambda s: (s[0], s[1].startswith("like_"), KINDS.index(s[1].removeprefix("like_"))))


def learn(docs: DataFrame, labelled: int = LABELLED) -> dict[str, Automaton]:
    """One automaton for each kind with labelled values: at most ``labelled`` distinct ones of the kind in all texts, by hash order.

    Values over ``LONGEST`` characters are no examples (their spans are found all the same); so the driver gets a bounded sample.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = {(kind, value) for text in part.column(0).to_pylist() for _, kind, _, value in base_spans(text) if len(value) <= LONGEST}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])
    values = docs.select(body().alias("text")).mapInArrow(task, "kind string, value string").distinct()
    by_kind = {}
    values = pin(values)
    for kind in KINDS:
        by_kind[kind] = [r.value for r in values.filter(F.col("kind") == kind).orderBy(F.xxhash64("kind", "value"), "value").limit(labelled).collect()]
    return {kind: Automaton(by_kind[kind]) for kind in KINDS if by_kind[kind]}


def scan(docs: DataFrame, automata: dict[str, Automaton] | None = None) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, spans_list``.

    Positions are code points of the whole text, the end exclusive; ``spans_list`` holds kind, start
    and end. Null text is empty: no spans, and the digest of nothing. A null id stays null, repeated
    rows repeat, other columns are not read, so their names cannot clash. A very long text is scanned whole, with or
    without white space, in time linear in its length for each state. Without labelled values nothing is added to the base spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if automata is None else automata)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [all_spans(t, shared.value) for t in part.column(1).to_pylist()]
            told = [[f"{k}:{s}:{e}" for s, k, e, _ in spans] for spans in found]
            base = [",".join(x for x in spans if not x.startswith("like_")) for spans in told]
            counts = [pa.array([sum(k == kind for _, k, _, _ in spans) for spans in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *counts, pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                 pa.array([",".join(spans) for spans in told], pa.string()),
                 pa.array([[{"kind": k, "start": s, "end": e} for s, k, e, _ in spans] for spans in found], pa.list_(SPAN))], NAMES)
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, spans_list array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(task, kinds)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "spans_list"]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` every found span is replaced by ``mark`` (spans that overlap count as one).

    A null text stays null. ``n_chars``, where there is one, is the new length of a changed text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def one(text: str) -> str:
        at, parts = 0, []
        for start, _, end, _ in all_spans(text, shared.value):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join(parts) + text[at:]

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        done, held, size = [], [], 0
        for i in range(len(texts)):  # a text at a time; of many, only the Arrow form is kept
            text = texts[i].as_py()
            held.append(None if text is None else one(text))
            size += len(text or "")
            if size > SLICE:
                done.append(pa.array(held, pa.string()))
                held, size = [], 0
        out = pa.concat_arrays([*done, pa.array(held, pa.string())])
        done, held = [], []
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # what the worker freed goes back to the system
            trim(0)
        return out

    out = docs.select(F.struct("*").alias("row"), clean("text").alias("clean"))
    size = F.when(F.col("clean") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.length("clean")) if "n_chars" in docs.columns else None
    return out.select(*[F.col("clean").alias("text") if c == "text" else size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns])
