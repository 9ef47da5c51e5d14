"""Linear recurrences as scans of affine maps: exponential and Wilder smoothing of rows in order.

Every kind of smoothing here is a row's map y -> a * y + b: a start is a map with a = 0, a missing
value one with a = 1 and b = 0.  Maps of consecutive rows compose to one map, so each chunk of ordered
rows is scanned on its own, chunks are composed in order by groups of ``FAN`` (in rounds, so that no key
gathers in one task), and a chunk's rows then follow from the value that enters it by one expression.
Recurrences over others' results take one more round each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import Ordered, lay_out
from tickloom.session import pin

#: (output, source, kind, parameter); a source is a column or an expression, also of earlier outputs.
#: Kinds: ema, ema_adjust, wilder, wilder_late, and expr, which takes the source as it is.
Step = tuple[str, "str | Column", str, float]
#: Maps that one group composes.
FAN = 1024
#: Rows that a block of the kernel holds.
BLOCK = 64


def affine_scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of rows 0 to t for every t: factors and offsets, column by column.

    Blocks of rows are scanned side by side, their totals by the same function.
    """
    n, k = a.shape
    m = -(-n // BLOCK)
    wide_a, wide_b = np.ones((m * BLOCK, k)), np.zeros((m * BLOCK, k))
    wide_a[:n], wide_b[:n] = a, b
    wide_a, wide_b = wide_a.reshape(m, BLOCK, k), wide_b.reshape(m, BLOCK, k)
    for t in range(1, BLOCK):
        wide_b[:, t] += wide_a[:, t] * wide_b[:, t - 1]
        wide_a[:, t] *= wide_a[:, t - 1]
    if m > 1:
        before_a, before_b = affine_scan(wide_a[:-1, -1], wide_b[:-1, -1])
        wide_b[1:] += wide_a[1:] * before_b[:, None]
        wide_a[1:] *= before_a[:, None]
    return wide_a.reshape(-1, k)[:n], wide_b.reshape(-1, k)[:n]


def _scanned(rows: DataFrame, by: list[str], order: str, n: int, shift: bool) -> DataFrame:
    """``rows`` with ``_a<i>``, ``_b<i>`` replaced by the compositions inside each group; ``shift``: of the rows before."""
    names = [f"_{c}{i}" for i in range(n) for c in "ab"]

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        a, b = (np.stack([group.column(f"_{c}{i}").to_numpy() for i in range(n)], axis=1) for c in "ab")
        a, b = affine_scan(a, b)
        if shift:
            a, b = np.vstack([np.ones((1, n)), a[:-1]]), np.vstack([np.zeros((1, n)), b[:-1]])
        for i in range(n):
            for c, v in (("a", a), ("b", b)):
                group = group.set_column(group.schema.get_field_index(f"_{c}{i}"), f"_{c}{i}", pa.array(v[:, i]))
        return group.select(fields)

    rows = rows.select(*[c for c in rows.columns if c not in names], *names)
    fields = rows.columns
    return rows.groupBy(*by).applyInArrow(run, rows.schema)


def _entering(chunks: DataFrame, n: int) -> DataFrame:
    """``_key, _chunk, _in<i>``: the value that enters each chunk, from the chunks' own maps."""
    chunks = pin(chunks)
    groups = chunks.withColumn("_group", F.floor(F.col("_chunk") / FAN))
    inside = _scanned(groups, ["_key", "_group"], "_chunk", n, shift=True)
    if (chunks.agg(F.max("_chunk")).first()[0] or 0) < FAN:
        return inside.select("_key", "_chunk", *[F.col(f"_b{i}").alias(f"_in{i}") for i in range(n)])
    whole = _scanned(groups, ["_key", "_group"], "_chunk", n, shift=False).groupBy("_key", "_group").agg(
        *[F.max_by(f"_{c}{i}", "_chunk").alias(f"_{c}{i}") for i in range(n) for c in "ab"])
    above = _entering(whole.withColumnRenamed("_group", "_chunk"), n).withColumnRenamed("_chunk", "_group")
    return inside.join(above, ["_key", "_group"]).select(
        "_key", "_chunk", *[(F.col(f"_a{i}") * F.col(f"_in{i}") + F.col(f"_b{i}")).alias(f"_in{i}") for i in range(n)])


def affine(rows: DataFrame, maps: dict[str, tuple[Column, Column]], single: bool = False) -> DataFrame:
    """Add y[t] = a[t] * y[t-1] + b[t] for each name, y before a key's first row being 0.

    ``rows`` come from ``Ordered.chunked`` without halo rows; a and b must not be null.  ``single``: every
    key is one chunk.
    """
    names = list(maps)
    mapped = rows.select("*", *[c.cast("double").alias(f"_{ab}{i}") for i, n in enumerate(names) for ab, c in zip("ab", maps[n], strict=True)])
    local = _scanned(mapped, ["_key", "_chunk"], "_rn", len(names), shift=False)
    if single:
        return local.select(*rows.columns, *[F.col(f"_b{i}").alias(n) for i, n in enumerate(names)])
    local = pin(local)
    last = local.groupBy("_key", "_chunk").agg(*[F.max_by(f"_{c}{i}", "_rn").alias(f"_{c}{i}") for i in range(len(names)) for c in "ab"])
    carry = _entering(last, len(names)).withColumnsRenamed({"_key": "_ckey", "_chunk": "_cchunk"})
    joined = local.join(carry, (F.col("_key") == F.col("_ckey")) & (F.col("_chunk") == F.col("_cchunk")))
    return joined.select(*rows.columns, *[(F.col(f"_a{i}") * F.col(f"_in{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)])


def _mean_maps(x: Column, alpha: float, prev: Column) -> tuple[Column, Column]:
    """Exponential mean without adjustment: a missing value leaves it and makes what is known count less afterwards.

    ``prev`` is the row number of the value before, null at the first one.
    """
    w = F.pow(F.lit(1 - alpha), F.col("_rn") - prev)
    return (F.when(x.isNull(), 1.0).when(prev.isNull(), 0.0).otherwise(w / (w + alpha)),
            F.when(x.isNull(), 0.0).when(prev.isNull(), x).otherwise(alpha * x / (w + alpha)))


def _smoothed(o: Ordered, steps: list[Step]) -> Ordered:
    """One round: recurrences that need no result of each other, as further columns of ``o.rows``."""
    late = [int(p) for _, _, kind, p in steps if kind == "wilder_late"]
    rows = o.chunked(before=max(late, default=0))
    for i, (_, source, _, _) in enumerate(steps):
        x = (F.col(source) if isinstance(source, str) else source).cast("double")
        rows = rows.withColumn(f"_x{i}", F.when(~F.isnan(x), x))
    for i, (_, _, kind, p) in enumerate(steps):
        if kind == "wilder_late":  # the mean of p rows up to row 2p, and smoothing from there
            mean = F.avg(f"_x{i}").over(o.last(int(p)))
            rows = rows.withColumn(f"_m{i}", mean).withColumn(f"_x{i}", F.when(F.col("_rn") == 2 * int(p), F.col(f"_m{i}")).when(F.col("_rn") > 2 * int(p), F.col(f"_x{i}")))
    spec: dict[str, tuple[str, Column]] = {}
    for i, (_, _, kind, _) in enumerate(steps):
        x = F.col(f"_x{i}")
        spec[f"_n{i}"] = ("sum", x.isNotNull().cast("long"))
        if kind in ("ema", "wilder_late"):
            spec[f"_before{i}"] = ("before", F.when(x.isNotNull(), F.col("_rn")))
        if kind == "wilder":
            spec[f"_s{i}"] = ("sum", F.coalesce(x, F.lit(0.0)))
    rows = o.running(rows, **spec)
    maps: dict[str, tuple[Column, Column]] = {}
    results: list[Column] = []
    for i, (_, _, kind, p) in enumerate(steps):
        x, n, y = F.col(f"_x{i}"), F.col(f"_n{i}"), F.col(f"_y{i}")
        if kind in ("ema", "wilder_late"):
            maps[f"_y{i}"] = _mean_maps(x, 2.0 / (p + 1) if kind == "ema" else 1.0 / p, F.col(f"_before{i}"))
            out = F.when(n >= 1, y)
            results.append(out if kind == "ema" else F.when(F.col("_rn") < 2 * int(p), F.col(f"_m{i}")).otherwise(out))
        elif kind == "ema_adjust":
            q = F.lit(1 - 2.0 / (p + 1))
            maps[f"_y{i}"], maps[f"_d{i}"] = (q, F.coalesce(x, F.lit(0.0))), (q, x.isNotNull().cast("double"))
            results.append(F.when(n >= int(p), F.try_divide(y, F.col(f"_d{i}"))))
        elif kind == "wilder":
            seen = x.isNotNull()
            maps[f"_y{i}"] = (F.when(seen & (n == int(p)), 0.0).when(seen & (n > int(p)), 1 - 1.0 / p).otherwise(1.0),
                              F.when(seen & (n == int(p)), F.col(f"_s{i}") / p).when(seen & (n > int(p)), x / p).otherwise(0.0))
            results.append(F.when(seen & (n >= int(p)), y))
        else:
            raise ValueError(f"unknown step {kind}")
    done = affine(rows.drop("_own"), maps, o.single)
    keep = o.rows.columns
    return Ordered(done.select(*keep, *[c.alias(s[0]) for c, s in zip(results, steps, strict=True)]), o.columns, o.chunk_rows, o.longest)


def smooth(df: DataFrame, keys: list[str], order: str, steps: list[Step], chunk_rows: int | None = None) -> DataFrame:
    """Add the columns of ``steps``, in order, for each key of a table of any size.

    ema: exponential mean of span p without adjustment; ema_adjust: with it, from the p-th value on;
    wilder: the mean of the first p values, then y + (x - y) / p, null at missing values; wilder_late: means
    of up to p rows until row 2p, Wilder smoothing from there.  Nulls and NaN are missing.  Steps between two
    expr steps (or up to a source that is one of their outputs) share a round over the rows.
    """
    o = lay_out(df, keys, [order], chunk_rows)
    waiting: list[Step] = []

    def flush(o: Ordered) -> Ordered:
        done = _smoothed(o, waiting) if waiting else o
        waiting.clear()
        return done

    for step in steps:
        name, source, kind, _ = step
        if kind == "expr":
            o = flush(o)
            o = Ordered(o.rows.withColumn(name, source.cast("double")), o.columns, o.chunk_rows, o.longest)
        else:
            if any(source == s[0] for s in waiting if isinstance(source, str)):
                o = flush(o)
            waiting.append(step)
    return flush(o).rows.select(*df.columns, *[F.nanvl(F.col(s[0]), F.lit(None).cast("double")).alias(s[0]) for s in steps])


def recurrence(o: Ordered, b: Column, a: float, name: str, keep: list[str]) -> DataFrame:
    """y[t] = a * y[t-1] + b[t] over each key of ordered rows, y before the first row being 0."""
    rows = o.chunked().select("_key", "_chunk", "_rn", *keep, b.cast("double").alias("_b"))
    return affine(rows, {name: (F.lit(a), F.col("_b"))}, o.single).select(*keep, name)


def ema_ticks(o: Ordered, x: Column, span: int, keep: list[str]) -> DataFrame:
    alpha = 2.0 / (span + 1)
    b = F.when(F.col("_rn") == 1, x).otherwise(x * alpha)
    return recurrence(o, b, 1 - alpha, f"ema_{span}", keep)
