"""Order statistics and frequencies of sliding row frames, in logarithmic time per row.

A built-in frame of n rows is folded anew for every row, and a median, a rank or the frequencies of
values would sort or filter n values each time.  Here each chunk (``ordered``) is indexed once, and all
its frames are answered together by a fixed number of passes over arrays:

* **median** and **rank** come from binary levels: values are replaced by their order in the chunk and
  split bit by bit, highest first; counts of zeros in front of each position lead any range of rows
  through the levels, to its k-th value or to the number of its smaller ones,
* **distinct** counts rows of the range whose last equal row lies before it, with the same levels over
  the places of those rows,
* **squares** (sum of squared frequencies) adds up what each row changes when it enters and leaves,
* **top** (highest frequency) keeps the number of values for each frequency while the frame moves on.

A chunk and its neighbouring rows are the unit of work, so memory follows the chunk, not the key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Result type of each kind.
KINDS = {"median": T.DoubleType(), "rank": T.DoubleType(), "distinct": T.LongType(), "hhi": T.DoubleType(), "top_share": T.DoubleType()}


class Levels:
    """Counts below a bound and k-th smallest codes of many ranges ``[lo, hi)`` at once."""

    def __init__(self, codes: np.ndarray):
        self.levels, self.beyond = [], int(codes.max(initial=0)) + 1
        for bit in reversed(range(self.beyond.bit_length())):
            high = (codes >> bit) & 1 == 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~high)])))
            codes = np.concatenate([codes[~high], codes[high]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many codes are less than ``bound``."""
        n, bound = np.zeros(len(lo), np.int64), np.minimum(bound, self.beyond)
        for bit, zeros in self.levels:
            high = (bound >> bit) & 1 == 1
            n += np.where(high, zeros[hi] - zeros[lo], 0)
            lo, hi = self._down(zeros, lo, high), self._down(zeros, hi, high)
        return n

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The code at place k (from 0) of the sorted range."""
        found = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            low = zeros[hi] - zeros[lo]
            high = k >= low
            k = np.where(high, k - low, k)
            found |= high.astype(np.int64) << bit
            lo, hi = self._down(zeros, lo, high), self._down(zeros, hi, high)
        return found

    @staticmethod
    def _down(zeros, at, high):
        return np.where(high, zeros[-1] + at - zeros[at], zeros[at])


def add_sliding(rows: DataFrame, spec: dict[str, tuple[str, str, int, int, int]]) -> DataFrame:
    """Own rows of chunked ``rows``, with a column for each entry of ``spec``.

    ``spec`` maps a name to (kind, column, start, end, minimum): the frame goes from ``start`` to ``end``
    rows behind the row (both at most 0, negative backwards), and the value is null until the frame holds
    ``minimum`` rows (for median and rank: values).  Kinds: ``median`` (interpolated), ``rank`` (share of
    the frame at or below the row's value, ties by their mean; null for a null), ``distinct``, ``hhi``
    (sum of squared shares) and ``top_share``.  Nulls are left out of every kind; not-a-number is the
    largest value and equals itself.  ``rows`` must come with enough neighbours (``Ordered.chunked``).
    """
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, KINDS[k]) for n, (k, *_) in spec.items()]])

    def chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        for name, (kind, col, start, end, minimum) in spec.items():
            table = table.append_column(name, _frames(table[col].combine_chunks(), kind, start, end, minimum))
        return table.filter(table["_own"])

    return rows.groupBy("_key", "_chunk").applyInArrow(chunk, schema)


def _frames(column, kind: str, start: int, end: int, minimum: int) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    m = len(column)
    at = np.arange(m)
    lo, hi = np.clip(at + start, 0, m), np.clip(at + end + 1, 0, m)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    values = np.concatenate([[0], np.cumsum(~missing)])
    filled = values[hi] - values[lo]
    if kind in ("median", "rank"):
        x = column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        out, known = (_medians if kind == "median" else _ranks)(x, missing, lo, hi, filled)
        return pa.array(out, pa.float64(), mask=~(known & (filled >= minimum)))
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    enough = hi - lo >= minimum
    if kind == "distinct":
        return pa.array(_distinct(codes, lo, hi), pa.int64(), mask=~enough)
    share = np.maximum(filled, 1).astype(float)
    out = _squares(codes, start, end, lo, hi) / share / share if kind == "hhi" else _tops(codes, lo, hi) / share
    return pa.array(out, pa.float64(), mask=~(enough & (filled > 0)))


def _ordered_codes(x, missing):
    """Distinct values in order, and each row's place among them; missing ones come last."""
    found, codes = np.unique(x[~missing], return_inverse=True)
    out = np.full(len(x), len(found), np.int64)
    out[~missing] = codes
    return found, out


def _medians(x, missing, lo, hi, filled):
    found, codes = _ordered_codes(x, missing)
    known = filled > 0
    if not len(found):
        return np.zeros(len(x)), known
    place = np.where(known, (filled - 1) / 2, 0.0)
    levels, values = Levels(codes), np.append(found, 0.0)
    below, above = (values[np.minimum(levels.kth(lo, hi, f(place).astype(np.int64)), len(found))] for f in (np.floor, np.ceil))
    return np.where(below == above, below, below + (above - below) * (place - np.floor(place))), known


def _ranks(x, missing, lo, hi, filled):
    _, codes = _ordered_codes(x, missing)
    levels = Levels(codes)
    less = levels.below(lo, hi, codes)
    equal = levels.below(lo, hi, codes + 1 - missing) - less
    return (less + (equal + 1) / 2) / np.maximum(filled, 1), ~missing


def _distinct(codes, lo, hi):
    m = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    last = np.zeros(m, np.int64)  # 1 + place of the last equal row, 0 for none
    last[order[1:]] = np.where(same, order[:-1] + 1, 0)
    last[codes < 0] = m + 1
    return Levels(last).below(lo, hi, lo + 1)


def _squares(codes, start, end, lo, hi):
    """A row that enters a frame with c equal rows adds 2c + 1 to the sum of squares; one that leaves takes it again."""
    m = len(codes)
    at, known = np.arange(m), codes >= 0
    keys = np.sort(codes[known] * (m + 1) + at[known])
    upto = lambda place: np.searchsorted(keys, codes * (m + 1) + place)
    enter = 2 * (upto(at) - upto(np.clip(at - end - 1 + start, 0, m))) + 1
    leave = 2 * (upto(np.clip(at - start + end + 2, 0, m)) - upto(at + 1)) + 1
    total = lambda change: np.concatenate([[0], np.cumsum(np.where(known, change, 0))])
    return total(enter)[hi] - total(leave)[lo]


def _tops(codes, lo, hi):
    held = [0] * (int(codes.max(initial=-1)) + 1)
    having = [0] * (len(codes) + 2)
    values, out, top, first, last = codes.tolist(), [], 0, 0, 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        for v in values[last:b]:
            if v >= 0:
                having[held[v]] -= 1
                held[v] += 1
                having[held[v]] += 1
                top = max(top, held[v])
        last = b
        for v in values[first:a]:
            if v >= 0:
                having[held[v]] -= 1
                held[v] -= 1
                having[held[v]] += 1
                if top and not having[top]:
                    top -= 1
        first = a
        out.append(top)
    return np.array(out, float)
