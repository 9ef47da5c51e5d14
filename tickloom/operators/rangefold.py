"""Folds over row ranges that end at each row, for any associative merge: extremes, drawdowns.

No row is copied to its windows.  A window inside one chunk is folded there from runs of doubling
length.  A longer one is the end of the chunk in which it begins (looked up by its first row), whole chunks between
(one row a chunk), and the beginning of the row's own chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import Ordered
from tickloom.session import pin


@dataclass(frozen=True)
class Fold:
    """Parts of a row's value, how two neighbouring runs merge (written for arrays and columns alike), what an empty run is, and the result's part."""

    leaf: Callable[[Column], list[Column]]
    merge: Callable[[list, list, Callable, Callable], list]
    empty: tuple[float, ...]
    result: int = 0

    def arrays(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return self.merge(a, b, np.minimum, np.maximum)


_known = lambda c, other: F.coalesce(F.nanvl(c, F.lit(None)), F.lit(other))
_INF = float("inf")
LEAST = Fold(lambda c: [_known(c, _INF)], lambda a, b, least, greatest: [least(a[0], b[0])], (_INF,))
GREATEST = Fold(lambda c: [_known(c, -_INF)], lambda a, b, least, greatest: [greatest(a[0], b[0])], (-_INF,))
#: Of running totals from a run's first row: total, highest, lowest, and the largest fall from a high to a later value.
DRAWDOWN = Fold(
    lambda c: [_known(c, 0.0), _known(c, -_INF), _known(c, _INF), F.when(c.isNull(), -_INF).otherwise(0.0)],
    lambda a, b, least, greatest: [a[0] + b[0], greatest(a[1], a[0] + b[1]), least(a[2], a[0] + b[2]), greatest(greatest(a[3], b[3]), a[1] - (a[0] + b[2]))],
    (0.0, -_INF, _INF, -_INF), 3)


def fold_runs(values: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, fold: Fold) -> list[np.ndarray]:
    """The fold of rows lo to hi (inclusive, none where hi < lo) for many ranges: runs of 1, 2, 4, ... rows, shortest first."""
    out = [np.full(len(lo), e) for e in fold.empty]
    at, length, width = lo.copy(), np.maximum(hi - lo + 1, 0), 1
    with np.errstate(invalid="ignore"):
        while len(lo) and length.max():
            odd = (length & 1).astype(bool)
            merged = fold.arrays([c[odd] for c in out], [v[at[odd]] for v in values])
            for c, m in zip(out, merged, strict=True):
                c[odd] = m
            at[odd] += width
            length >>= 1
            if length.max():
                values = fold.arrays([v[:-width] for v in values], [v[width:] for v in values])
            width *= 2
    return out


def range_folds(o: Ordered, windows: dict[str, tuple[Column, Column | list[Column], Fold]]) -> DataFrame:
    """``o.rows`` with, for each name, the fold of ``value`` over the rows from number ``first`` of the key to the row itself.

    ``windows`` maps a name to (first, value, fold); a null ``first`` gives null, as does a window without known values.
    A value may also be the list of a fold's parts, where rows are runs that were folded before.
    """
    names, folds = list(windows), [w[2] for w in windows.values()]
    rows = o.chunked().drop("_own")
    columns = o.rows.columns
    for i, (first, value, fold) in enumerate(windows.values()):
        rows = rows.withColumns({f"_f{i}": first.cast("long"), **{f"_p{i}_{j}": c.cast("double") for j, c in enumerate(value if isinstance(value, list) else fold.leaf(value.cast("double")))}})
    parts = [(i, j) for i, f in enumerate(folds) for j in range(len(f.empty))]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"_e{i}_{j}", T.DoubleType()) for i, j in parts]])
    single = o.single

    def inside(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rn")
        n, start = group.num_rows, group.column("_rn")[0].as_py()
        here = np.arange(n)
        for i, fold in enumerate(folds):
            values = [group.column(f"_p{i}_{j}").to_numpy() for j in range(len(fold.empty))]
            first = group.column(f"_f{i}").combine_chunks().fill_null(start + n).to_numpy() - start
            own = fold_runs(values, np.clip(first, 0, n), here, fold)
            rest = values if single else fold_runs(values, here, np.full(n, n - 1), fold)
            for j in range(len(fold.empty)):
                group = group.set_column(group.schema.get_field_index(f"_p{i}_{j}"), f"_p{i}_{j}", pa.array(own[j]))
                group = group.append_column(f"_e{i}_{j}", pa.array(rest[j]))
        return group

    local = rows.groupBy("_key", "_chunk").applyInArrow(inside, schema)
    if not single:
        local = pin(local)
        for i, fold in enumerate(folds):
            local = _across(local, i, fold, o.chunk_rows)
    value = lambda i, f: F.col(f"_p{i}_{f.result}")
    finite = lambda c: F.when((c != _INF) & (c != -_INF), c)
    return local.select(*columns, *[F.when(F.col(f"_f{i}").isNotNull(), finite(value(i, f))).alias(n) for i, (n, f) in enumerate(zip(names, folds, strict=True))])


def _across(local: DataFrame, i: int, fold: Fold, size: int) -> DataFrame:
    """Complete ``_p<i>`` of the windows that begin in an earlier chunk."""
    k = range(len(fold.empty))
    begin = F.floor((F.col(f"_f{i}") - 1) / F.lit(size))
    reach = local.withColumn("_c", F.when(begin < F.col("_chunk"), begin))
    ends = local.select(F.struct("_key", F.col("_rn").alias("_at")).alias("_start"), *[F.col(f"_e{i}_{j}").alias(f"_s{j}") for j in k])
    whole = local.groupBy("_key", "_chunk").agg(*[F.min_by(f"_e{i}_{j}", "_rn").alias(f"_w{j}") for j in k]).withColumnsRenamed({"_key": "_wkey", "_chunk": "_wchunk"})
    pairs = reach.where(F.col("_chunk") - F.col("_c") > 1).select("_key", "_c", F.col("_chunk").alias("_d")).distinct()
    kind = T.StructType([*pairs.schema.fields, *[T.StructField(f"_m{j}", T.DoubleType()) for j in k]])

    def between(p: pa.Table, w: pa.Table) -> pa.Table:
        w = w.sort_by("_wchunk")
        first = w.column("_wchunk")[0].as_py() if w.num_rows else 0
        c, d = (p.column(x).to_numpy() for x in ("_c", "_d"))
        for j, v in enumerate(fold_runs([w.column(f"_w{j}").to_numpy() for j in k], c + 1 - first, d - 1 - first, fold)):
            p = p.append_column(f"_m{j}", pa.array(v))
        return p

    # a row a chunk, so a key's table is small however long the key is
    middle = pairs.groupBy("_key").cogroup(whole.groupBy("_wkey")).applyInArrow(between, kind).select(F.struct("_key", "_c", "_d").alias("_pair"), *[f"_m{j}" for j in k])
    far = reach.where("_c IS NOT NULL").withColumns({"_start": F.struct("_key", F.col(f"_f{i}").alias("_at")), "_pair": F.struct("_key", "_c", F.col("_chunk").alias("_d"))})
    far = far.join(ends, "_start").join(middle, "_pair", "left")
    merge = lambda a, b: fold.merge(a, b, F.least, F.greatest)
    total = merge(merge([F.col(f"_s{j}") for j in k], [F.coalesce(f"_m{j}", F.lit(e)) for j, e in enumerate(fold.empty)]), [F.col(f"_p{i}_{j}") for j in k])
    done = far.select(*[c for c in local.columns if not c.startswith(f"_p{i}_")], *[c.alias(f"_p{i}_{j}") for j, c in enumerate(total)])
    return reach.where("_c IS NULL").drop("_c").unionByName(done)
