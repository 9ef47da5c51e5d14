"""First passage: the first later row of a key at which one of several barriers is met.

Inside a chunk a search walks down doubling levels of block extremes: a block that stays inside
the barrier is skipped whole.  A search that leaves its chunk first finds the first later chunk whose
extremes meet a barrier (a key has few chunks, each one row here), and then walks down in that chunk only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import Ordered
from tickloom.session import pin

#: What was met, in the order that counts where one row meets several.
KINDS = ("stop", "target", "opposite")


def first_at_most(values: np.ndarray, start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each search the first index from ``start`` on with a value <= ``bound``, or the length; missing values meet nothing."""
    n = len(values)
    levels = [np.where(np.isnan(values), np.inf, values)]
    while 2 << (len(levels) - 1) <= n:
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    at = start.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) <= n
        clear = np.zeros(len(at), bool)
        clear[fits] = levels[k][at[fits]] > bound[fits]
        at[clear] += 1 << k
    return np.where((at < n) & (levels[0][np.minimum(at, n - 1)] <= bound), at, n)


def first_equal(values: np.ndarray, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each search the first index from ``start`` on with the value ``wanted``, or the length."""
    out = np.full(len(start), len(values))
    for v in np.unique(wanted):
        places, who = np.flatnonzero(values == v), wanted == v
        found = np.searchsorted(places, start[who])
        out[who] = np.append(places, len(values))[found]
    return out


def search(low: np.ndarray, high: np.ndarray, position: np.ndarray, start: np.ndarray, side: np.ndarray, stop: np.ndarray,
           target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row that meets anything (or the length), and what it meets."""
    long = side > 0
    down = first_at_most(low, start, np.where(long, stop, target))
    up = first_at_most(-high, start, -np.where(long, target, stop))
    met = np.stack([np.where(long, down, up), np.where(long, up, down), first_equal(position, start, -side)])
    return met.min(axis=0), met.argmin(axis=0)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(float)


def barriers(o: Ordered, sweep: list[tuple[float, float]], holding: int | None = None) -> DataFrame:
    """Per row of ``o`` with an ``entry`` and each (stop, target) of ``sweep``: the row that ends the trade.

    ``o.rows`` need ts, low, high, close, position, entry (null where no trade starts) and _n, the rows of the key.
    Adds ``stop, target, exit_ts, reason, exit``.  The reason is stop, target, opposite, session_end (the key's
    last row) or holding_limit (``holding`` rows later); where a row meets several, the first of these.
    """
    rows = o.chunked().drop("_own")
    columns = list(rows.columns)
    extra = [T.StructField(n, T.DoubleType()) for n in ("stop", "target", "_stop", "_target", "exit")] + [
        T.StructField("exit_ts", rows.schema["ts"].dataType), T.StructField("reason", T.StringType()), T.StructField("_end", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *extra])

    def inside(group: pa.Table) -> pa.Table:
        group = group.sort_by("_rn")
        low, high, close, position, entry = (_numbers(group, c) for c in ("low", "high", "close", "position", "entry"))
        rn, last = group.column("_rn").to_numpy(), group.column("_n").to_numpy()
        who = np.flatnonzero(~np.isnan(entry))
        parts = []
        for stop, target in sweep:
            side, e = position[who], entry[who]
            st, tg = e * (1 - side * stop), e * (1 + side * target)
            at, kind = search(low, high, position, who + 1, side, st, tg)
            end = np.minimum(last[who], rn[who] + holding) if holding else last[who]
            at_end = end - rn[0]  # index of the last row that may close the trade, perhaps beyond this chunk
            hit = at <= np.minimum(at_end, len(low) - 1)
            over = ~hit & (at_end < len(low))
            place = np.where(hit, at, np.where(over, at_end, 0))
            known = hit | over
            price = np.where(hit & (kind == 0), st, np.where(hit & (kind == 1), tg, close[place]))
            reason = np.where(hit, np.array(KINDS)[kind], np.where(end == last[who], "session_end", "holding_limit"))
            part = group.take(pa.array(who))
            new = (np.full(len(who), stop), np.full(len(who), target), st, tg, pa.array(price, mask=~known),
                   pa.array(group.column("ts").combine_chunks().take(pa.array(place, mask=~known))), pa.array(reason.astype(object), pa.string(), mask=~known), end.astype(np.int64))
            for f, c in zip(extra, new, strict=True):
                part = part.append_column(f.name, c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c))
            parts.append(part)
        return pa.concat_tables(parts)

    found = rows.groupBy("_key", "_chunk").applyInArrow(inside, schema)
    keep = [*[c for c in columns if c != "_chunk"], "stop", "target", "exit_ts", "reason", "exit"]
    if o.single:
        return found.select(*keep)
    found = pin(found)
    return found.where("reason IS NOT NULL").select(*keep).unionByName(_beyond(rows, found.where("reason IS NULL"), holding).select(*keep))


def _beyond(rows: DataFrame, open_: DataFrame, holding: int | None) -> DataFrame:
    """Trades that no row of their own chunk closes: the first later chunk that meets anything, or the row at which they end."""
    chunks = rows.groupBy("_key", "_chunk").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.collect_set("position").alias("sides"))
    per_key = chunks.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_chunk", "lo", "hi", "sides"))).alias("_chunks"))  # a row per chunk
    long = F.col("position") > 0
    down, up = F.when(long, F.col("_stop")).otherwise(F.col("_target")), F.when(long, F.col("_target")).otherwise(F.col("_stop"))
    meets = lambda c: (c["_chunk"] > F.col("_chunk")) & ((c["lo"] <= down) | (c["hi"] >= up) | F.array_contains(c["sides"], -F.col("position")))
    asked = pin(open_.join(per_key, "_key").withColumn("_to", F.get(F.filter("_chunks", meets), F.lit(0))["_chunk"]).drop("_chunks"))
    # Searches that go to one chunk meet it by the chunk they come from, so that a common target does not gather in one group.
    here = rows.join(asked.where("_to IS NOT NULL").select("_key", F.col("_to").alias("_chunk"), F.col("_chunk").alias("_from")).distinct(), ["_key", "_chunk"]).select(
        F.col("_key").alias("_hkey"), F.col("_chunk").alias("_hchunk"), F.col("_from").alias("_hfrom"), F.col("_rn").alias("_hrn"), F.col("ts").alias("_hts"),
        *[F.col(c).alias(f"_h{c}") for c in ("low", "high", "close", "position")])
    fields = [f for f in asked.schema.fields if f.name not in ("exit", "exit_ts", "reason")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, asked.schema["exit"], asked.schema["exit_ts"], asked.schema["reason"], T.StructField("_at", T.LongType())])

    def there(q: pa.Table, h: pa.Table) -> pa.Table:
        q, h = q.select(names), h.sort_by("_hrn")
        low, high, close, position = (_numbers(h, f"_h{c}") for c in ("low", "high", "close", "position"))
        st, tg = _numbers(q, "_stop"), _numbers(q, "_target")
        at, kind = search(low, high, position, np.zeros(q.num_rows, int), _numbers(q, "position"), st, tg)
        place = np.minimum(at, max(h.num_rows - 1, 0))
        price = np.where(kind == 0, st, np.where(kind == 1, tg, close[place]))
        return (q.append_column("exit", pa.array(price)).append_column("exit_ts", h.column("_hts").combine_chunks().take(pa.array(place)))
                .append_column("reason", pa.array(np.array(KINDS)[kind].tolist(), pa.string())).append_column("_at", h.column("_hrn").combine_chunks().take(pa.array(place))))

    met = asked.where("_to IS NOT NULL").groupBy("_key", "_to", "_chunk").cogroup(here.groupBy("_hkey", "_hchunk", "_hfrom")).applyInArrow(there, schema)
    met = pin(met)
    ended = met.where("_at > _end").select(*names).unionByName(asked.where("_to IS NULL").select(*names))
    ends = rows.select(F.col("_key").alias("_ekey"), F.col("_rn").alias("_ern"), F.col("ts").alias("exit_ts"), F.col("close").alias("exit"))
    ended = ended.join(ends, (F.col("_key") == F.col("_ekey")) & (F.col("_end") == F.col("_ern"))).withColumn(
        "reason", F.when(F.col("_end") == F.col("_n"), "session_end").otherwise("holding_limit"))
    return met.where("_at <= _end").drop("_at").unionByName(ended.drop("_ekey", "_ern"))
