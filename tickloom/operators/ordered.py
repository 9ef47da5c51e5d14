"""Ordered windows that do not need a whole key in one task.

``Window.partitionBy(symbol).orderBy(ts)`` sends every row of a symbol to one task, which cannot
work when one contract holds a third of the table.  Here the rows are range-sorted over all tasks
by (keys, order), numbered per key, and cut into chunks of a fixed number of rows:

* frames of a bounded number of rows get the neighbouring rows as copies ("halo") from the
  adjacent chunk,
* frames of a bounded time are differences of running totals (sums) or folds of row ranges (extremes),
* unbounded frames are finished with a carry: one row per chunk, combined over earlier chunks.

Every chunk is an independent task-sized group, and the results equal those of the plain window.
Tables that a clock bounds (bars per symbol) do not need this; they use plain windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import pin, small_side

MIN_CHUNK_ROWS, MAX_CHUNK_ROWS = 4_096, 262_144
HELPERS = ("_key", "_rn", "_chunk", "_own")


@dataclass(frozen=True)
class Ordered:
    """Rows with ``_key`` (struct of the keys) and ``_rn`` (1-based row number inside the key)."""

    rows: DataFrame
    columns: tuple[str, ...]
    chunk_rows: int
    #: Rows of the longest key, where known.
    longest: int | None = None

    @property
    def single(self) -> bool:
        """Every key is one chunk, so nothing needs to be carried from chunk to chunk."""
        return self.longest is not None and self.longest <= self.chunk_rows

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy("_key", "_chunk").orderBy("_rn")

    def last(self, n: int) -> WindowSpec:
        """Frame of the current row and the n - 1 rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def frame(self, start: int, end: int) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    def chunked(self, before: int = 0, after: int = 0) -> DataFrame:
        """Rows in chunks, each with the ``before``/``after`` neighbouring rows it needs."""
        size = max(self.chunk_rows, before, after)
        chunk = F.floor((F.col("_rn") - 1) / F.lit(size))
        place = (F.col("_rn") - 1) % F.lit(size)
        rows = self.rows.withColumn("_home", chunk)
        targets = [F.col("_home")]
        if before:
            targets.append(F.when(place >= size - before, F.col("_home") + 1))
        if after:
            targets.append(F.when(place < after, F.col("_home") - 1))
        if len(targets) == 1:
            return rows.withColumnRenamed("_home", "_chunk").withColumn("_own", F.lit(True))
        return (
            rows.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
            .withColumn("_own", F.col("_chunk") == F.col("_home"))
            .drop("_home")
        )

    def running(self, df: DataFrame, **spec: tuple[str, Column]) -> DataFrame:
        """Add unbounded-preceding values to chunked rows; drops the halo.

        ``spec`` maps a name to (kind, value) with kind one of sum, max, min, last, before, next.
        ``last`` is the latest non-null value; ``before`` the latest non-null one of strictly
        earlier rows; ``next`` the first non-null value at or after the row.
        """
        own = df.where("_own")
        for name, (_, value) in spec.items():
            own = own.withColumn(f"_v_{name}", value)
        upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        frames = {"before": self.window.rowsBetween(Window.unboundedPreceding, -1),
                  "next": Window.partitionBy("_key", "_chunk").orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)}
        if self.single:
            return own.select("*", *[_over(kind, F.col(f"_v_{n}"), frames.get(kind, upto)).alias(n)
                                     for n, (kind, _) in spec.items()]).drop(*[f"_v_{n}" for n in spec])
        totals = []
        for name, (kind, _) in spec.items():
            v = F.col(f"_v_{name}")
            totals.append(_total(kind, v).alias(f"_t_{name}"))
        earlier = (Window.partitionBy("_key").orderBy("_chunk")
                   .rowsBetween(Window.unboundedPreceding, -1))
        later = (Window.partitionBy("_key").orderBy(F.desc("_chunk"))
                 .rowsBetween(Window.unboundedPreceding, -1))
        carry = own.groupBy("_key", "_chunk").agg(*totals).select(
            F.col("_key").alias("_ckey"), F.col("_chunk").alias("_cchunk"),
            *[_over(kind, F.col(f"_t_{n}"), later if kind == "next" else earlier).alias(f"_c_{n}")
              for n, (kind, _) in spec.items()])
        local = own.select("*", *[
            _over(kind, F.col(f"_v_{n}"), frames.get(kind, upto)).alias(f"_l_{n}")
            for n, (kind, _) in spec.items()])
        out = local.join(
            carry, (F.col("_key") == F.col("_ckey")) & (F.col("_chunk") == F.col("_cchunk")), "left")
        for name, (kind, _) in spec.items():
            here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
            out = out.withColumn(name, _merge(kind, here, there))
        spare = [f"_{p}_{n}" for n in spec for p in "vlc"]
        return out.drop("_ckey", "_cchunk", *spare)

    def running_peak(self, df: DataFrame, value: Column, total: str, peak: str) -> DataFrame:
        """Running sum and the highest running sum so far, in one pass; drops the halo."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, 0)
        local = df.where("_own").withColumn("_lc", F.sum(value).over(upto)).withColumn("_lp", F.max("_lc").over(upto))
        parts = local.groupBy("_key", "_chunk").agg(F.max_by("_lc", "_rn").alias("_s"), F.max("_lc").alias("_m"))
        earlier = (Window.partitionBy("_key").orderBy("_chunk")
                   .rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("_sb", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        parts = parts.select("_key", "_chunk", "_sb", F.max(F.col("_sb") + F.col("_m")).over(earlier).alias("_pb"))
        return local.join(parts, ["_key", "_chunk"]).withColumns({
            total: F.col("_sb") + F.col("_lc"), peak: F.greatest("_pb", F.col("_sb") + F.col("_lp"))}).drop("_lc", "_lp", "_sb", "_pb")

    def finish(self, df: DataFrame, *keep: str | Column) -> DataFrame:
        """Own rows only, without the helper columns."""
        own = df.where("_own")
        return own.select(*keep) if keep else own.drop(*HELPERS)

    def sizes(self) -> DataFrame:
        """Row count per key, as ``_key`` and ``_n``."""
        return self.rows.groupBy("_key").agg(F.max("_rn").alias("_n"))

    def with_size(self) -> DataFrame:
        """Rows with the row count of their key in ``_n``."""
        return self.rows.join(small_side(self.sizes()), "_key")


def _total(kind: str, v: Column) -> Column:
    if kind == "next":
        return F.min_by(v, F.when(v.isNotNull(), F.col("_rn")))
    if kind in ("last", "before"):
        return F.max_by(v, F.when(v.isNotNull(), F.col("_rn")))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v)


def _over(kind: str, v: Column, w: WindowSpec) -> Column:
    if kind in ("last", "before", "next"):  # frames of "next" run backwards: Spark reads a frame to the end anew for every row
        return F.last(v, ignorenulls=True).over(w)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v).over(w)


def _merge(kind: str, here: Column, there: Column) -> Column:
    if kind == "sum":
        return F.when(there.isNull(), here).when(here.isNull(), there).otherwise(here + there)
    if kind == "max":
        return F.greatest(here, there)
    if kind == "min":
        return F.least(here, there)
    return F.coalesce(here, there)


def lay_out(df: DataFrame, keys: list[str], order: list[str | Column],
            chunk_rows: int | None = None) -> Ordered:
    """Sort by (keys, order) over all tasks and number the rows of each key.

    ``order`` must be total inside a key.  The sorted rows are checkpointed, so that partition ids
    and positions cannot change when an executor is lost.
    """
    cols = tuple(df.columns)
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = pin(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
        .withColumn("_seg", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()))
    per = placed.groupBy("_key", "_seg").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    earlier = (Window.partitionBy("_key").orderBy("_seg")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = pin(per.withColumn("_passed", F.coalesce(F.sum("_cnt").over(earlier), F.lit(0))).select(
        "_key", "_seg", "_cnt", (F.col("_passed") + F.col("_cnt")).alias("_upto"), (F.col("_first") - F.col("_passed")).alias("_base")))
    n, total, longest = offsets.agg(F.count(F.lit(1)), F.coalesce(F.sum("_cnt"), F.lit(0)), F.coalesce(F.max("_upto"), F.lit(0))).first()
    rows = (
        placed.join(small_side(offsets.drop("_cnt", "_upto"), rows=n), ["_key", "_seg"])
        .withColumn("_rn", F.col("_pos") - F.col("_base") + 1)
        .select(*cols, "_key", "_rn"))
    return Ordered(rows, cols, chunk_rows or chunk_size(df.sparkSession, total), longest)


def chunk_size(spark: SparkSession, rows: int) -> int:
    """About four chunks per shuffle task, inside fixed limits; the setting ``tickloom.chunk.rows`` overrides it."""
    if given := spark.conf.get("tickloom.chunk.rows", None):
        return int(given)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_CHUNK_ROWS, min(MAX_CHUNK_ROWS, rows // (4 * tasks)))


def time_values(df: DataFrame, keys: list[str], ts: str, spec: dict[str, tuple[str, Column, float]],
                extra: DataFrame | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Add values over the last ``seconds`` up to each row's time; rows of the same time count.

    ``spec`` maps a name to (kind, value, seconds) with kind sum, min, max or oldest (the earliest time,
    in microseconds, of a row whose value is known).  Rows of one (key,
    time) are first reduced to one row, so even a huge group of equal times is one row of the
    ordered frame; the values are then joined back.  Neither kind copies rows; extremes are taken in double precision.  ``extra`` holds keys and times (only) at which
    the values are wanted instead of the rows of ``df``.
    """
    from tickloom.operators.rangefold import GREATEST, LEAST, range_folds

    sums = {n: x for n, x in spec.items() if x[0] in ("sum", "oldest")}
    ends = {n: x for n, x in spec.items() if x[0] in ("min", "max")}
    at = df if extra is None else extra
    out = _time_sums(df, keys, ts, sums, extra, chunk_rows) if sums else at
    if not ends:
        return out
    kinds = dict(df.select(*[v.alias(n) for n, (_, v, _) in ends.items()]).dtypes)
    rows = df.select(*keys, ts, *[v.alias(f"_p_{n}") for n, (_, v, _) in ends.items()])
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, ts), allowMissingColumns=True)
    points = pin(rows.groupBy(*keys, ts).agg(*[(F.min if k == "min" else F.max)(f"_p_{n}").alias(f"_p_{n}") for n, (k, _, _) in ends.items()]))
    reach = sorted({float(sec) for *_, sec in ends.values()})
    one = F.lit(1)
    points = _time_sums(points, keys, ts, {f"_c_{i}": ("sum", one, sec) for i, sec in enumerate(reach)}, None, chunk_rows)
    folded = range_folds(lay_out(points, keys, [ts], chunk_rows), {
        n: (F.col("_rn") - F.col(f"_c_{reach.index(float(sec))}") + 1, F.col(f"_p_{n}").cast("double"), LEAST if k == "min" else GREATEST) for n, (k, _, sec) in ends.items()})
    folded = folded.select(F.struct(*keys, ts).alias("_at"), *[F.col(n).cast(kinds[n]).alias(n) for n in ends])
    return out.withColumn("_at", F.struct(*keys, ts)).join(folded, "_at", "left").drop("_at")


def _time_sums(df: DataFrame, keys: list[str], ts: str, spec: dict[str, tuple[str, Column, float]],
               extra: DataFrame | None, chunk_rows: int | None) -> DataFrame:
    """Sums over the last ``seconds`` as a difference of running totals, linear in the rows for any window.

    Each time is stacked with marks ``seconds`` before it, at which the total of strictly earlier
    times is wanted; one running pass over that order gives both totals, and the oldest time behind a mark.
    Windows that share a value (the same object) share its total.  Fractions are summed as decimals of
    ten places, so that differences are exact.
    """
    kinds = dict(df.select(*[v.alias(n) for n, (_, v, _) in spec.items()]).dtypes)
    exact = lambda n, v: v.cast("decimal(28,10)") if kinds[n] in ("double", "float") else v
    ids = list(dict.fromkeys(id(v) for _, v, _ in spec.values()))
    number = {n: ids.index(id(v)) for n, (_, v, _) in spec.items()}
    values = {number[n]: exact(n, v) for n, (_, v, _) in spec.items()}
    rows = df.select(*keys, ts, *[v.alias(f"_p_{k}") for k, v in values.items()])
    at = df if extra is None else extra
    if extra is not None:
        rows = rows.unionByName(extra.select(*keys, ts), allowMissingColumns=True)
    points = rows.groupBy(*keys, ts).agg(*[F.sum(f"_p_{k}").alias(f"_p_{k}") for k in values], *[F.count(f"_p_{k}").alias(f"_c_{k}") for k in values])
    reach = sorted({int(sec * 1_000_000) for *_, sec in spec.values()})
    stops = F.array(F.lit(-1).cast("long"), *[F.lit(x).cast("long") for x in reach])  # -1: the point itself
    stacked = points.withColumn("_s", F.explode(stops)).withColumn("_x", F.unix_micros(ts) - F.greatest("_s", F.lit(0)))
    own = F.col("_s") == -1
    stacked = stacked.select(*keys, ts, "_s", "_x", own.cast("int").alias("_own"),
                             *[F.when(own, F.col(f"{p}{k}")).alias(f"{p}{k}") for k in values for p in ("_p_", "_c_")])
    o = lay_out(stacked, keys, ["_x", "_own", "_s"], chunk_rows)
    oldest = sorted({number[n] for n, (kind, *_) in spec.items() if kind == "oldest"})
    totals = o.running(o.chunked(), **{f"_t{p}{k}": ("sum", F.col(f"{p}{k}")) for k in values for p in ("_p_", "_c_")},
                       **{f"_o_{k}": ("next", F.when(F.col(f"_c_{k}") > 0, F.col("_x"))) for k in oldest})
    pick = lambda c, s: F.max(F.when(F.col("_s") == s, F.col(c)))
    wanted = {n: int(sec * 1_000_000) for n, (*_, sec) in spec.items()}
    framed = totals.groupBy(*keys, ts).agg(*[(F.coalesce(pick(f"_t{p}{number[n]}", -1), F.lit(0)) - F.coalesce(pick(f"_t{p}{number[n]}", wanted[n]), F.lit(0))).alias(f"{p}{n}")
                                             for n in spec for p in ("_p_", "_c_")], *[pick(f"_o_{number[n]}", wanted[n]).alias(f"_o_{n}") for n, x in spec.items() if x[0] == "oldest"])
    back = lambda n: F.col(f"_o_{n}") if spec[n][0] == "oldest" else F.col(f"_p_{n}").cast(
        "double" if kinds[n] in ("double", "float") else "decimal(38,10)" if kinds[n].startswith("decimal") else "long")
    framed = framed.select(F.struct(*keys, ts).alias("_at"), *[F.when(F.col(f"_c_{n}") > 0, back(n)).alias(n) for n in spec])
    return at.withColumn("_at", F.struct(*keys, ts)).join(framed, "_at", "left").drop("_at")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    chunk_rows: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, exact, without gathering a key in one task.

    Distinct values are counted with partial aggregation; their cumulative counts come from the
    ordered chunks; only the rows that hold a wanted rank are aggregated.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).cast("long").alias("_w"))
    laid = lay_out(hist, keys, [value], chunk_rows)
    rows = laid.chunked()
    whole = Window.partitionBy("_key")
    parts = rows.groupBy("_key", "_chunk").agg(F.sum("_w").alias("_s"))
    base = parts.select(
        "_key", "_chunk", F.sum("_s").over(whole).alias("_total"),
        F.coalesce(F.sum("_s").over(whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("_w").over(laid.window.rowsBetween(Window.unboundedPreceding, 0))
    ranked = rows.withColumn("_local", upto).join(base, ["_key", "_chunk"]).withColumn("_upto", F.col("_before") + F.col("_local"))
    low = F.col("_upto") - F.col("_w")
    parts = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        hit = lambda r: (r >= low) & (r < F.col("_upto"))
        parts += [
            F.max(F.when(hit(lo), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(hit(hi), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_f_{name}"),
        ]
    agg = ranked.groupBy(*keys).agg(*parts) if keys else ranked.agg(*parts)
    return agg.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs])
