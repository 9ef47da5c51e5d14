"""Labels, splits, folds, scaling and encoding for training tables.

Labels that need a threshold take it from a small fitted table: fit on the training rows to avoid
look-ahead, or on all rows for the in-sample form.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import Ordered, exact_quantiles, lay_out
from tickloom.operators.windows import clip, rstd
from tickloom.session import small_side


def three_way(x: Column, low: Column, high: Column) -> Column:
    return F.when(x > high, 1).when(x < low, -1).otherwise(0)


def bar_labels(bars: DataFrame, horizon: int, threshold: float) -> DataFrame:
    """Direction, class, return and magnitude of the next ``horizon`` bars; rows without a future go."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = F.lead("close", horizon).over(w) / F.col("close") - 1
    out = bars.withColumn("target_return", r).where("target_return IS NOT NULL")
    x = F.col("target_return")
    return out.withColumns({"target_binary": (x > 0).cast("int"), "target_class": three_way(x, F.lit(-threshold), F.lit(threshold)),
                            "target_magnitude": F.abs(x)})


def future_returns(ticks: DataFrame, horizon: int, vol_rows: int = 0, chunk_rows: int | None = None) -> DataFrame:
    """Return over the next ``horizon`` ticks, optionally divided by its rolling deviation."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    rows = o.chunked(before=vol_rows, after=horizon).withColumn(
        "ret", F.lead("price", horizon).over(o.window) / F.col("price") - 1)
    if vol_rows:
        rows = rows.withColumn("vol", rstd(F.col("ret"), o.window, vol_rows)).withColumn(
            "ret_per_vol", F.col("ret") / clip(F.col("vol"), 0.0001))
    return o.finish(rows.where("ret IS NOT NULL"))



def fit_quantiles(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return exact_quantiles(df, ["symbol"], col, {"lo": low, "hi": high})


def fit_sigma(df: DataFrame, col: str, k: float, centred: bool) -> DataFrame:
    m = F.avg(col) if centred else F.lit(0.0)
    return df.groupBy("symbol").agg((m - k * F.stddev_samp(col)).alias("lo"), (m + k * F.stddev_samp(col)).alias("hi"))


def with_floor(fitted: DataFrame, floor: float) -> DataFrame:
    """Thresholds at least ``floor`` away from zero."""
    return fitted.select("symbol", F.least("lo", F.lit(-floor)).alias("lo"), F.greatest("hi", F.lit(floor)).alias("hi"))


def label(df: DataFrame, fitted: DataFrame, col: str, name: str = "target") -> DataFrame:
    out = df.join(small_side(fitted), "symbol")
    return out.withColumn(name, F.coalesce(three_way(F.col(col), F.col("lo"), F.col("hi")), F.lit(0))).drop("lo", "hi")


def book_targets(tops: DataFrame, horizon: int, spread_bins: list[float], sweep_rows: int) -> DataFrame:
    """Next spread, spread and imbalance class, price move after ``horizon`` seconds, depth change, coming sweep."""
    w = Window.partitionBy("k").orderBy("ts")
    ahead = Window.partitionBy("k").orderBy(F.unix_seconds("ts")).rangeBetween(0, horizon)
    b, a = F.col("bid_qty"), F.col("ask_qty")
    t = tops.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": (F.col("ask") + F.col("bid")) / 2,
                          "imbalance": (b - a) / (b + a), "depth": b + a, "sweep": ((b < 10) | (a < 10)).cast("int")})
    cls = sum(((F.col("spread") > e).cast("int") for e in spread_bins), F.lit(0))
    im = F.col("imbalance")
    coming = w.rowsBetween(1, sweep_rows)
    return t.withColumns({
        "spread_next": F.lead("spread").over(w), "spread_class": cls, "imbalance_next": F.lead("imbalance").over(w),
        "imbalance_class": F.when(im <= -0.6, "strong_sell").when(im <= -0.2, "sell").when(im <= 0.2, "neutral").when(
            im <= 0.6, "buy").otherwise("strong_buy"),
        "price_move": F.last("mid").over(ahead) / F.col("mid") - 1, "consumption": F.lead("depth").over(w) / F.col("depth") - 1,
        "sweep_coming": F.when(F.count("sweep").over(coming) >= sweep_rows, F.max("sweep").over(coming))})


def split(o: Ordered, train: float, valid: float) -> DataFrame:
    """train / valid / test in time order, by the row number inside each key."""
    rows = o.with_size()
    i, n = F.col("_rn") - 1, F.col("_n")
    return rows.withColumn("split", F.when(i < F.floor(n * train), "train").when(
        i < F.floor(n * train) + F.floor(n * valid), "valid").otherwise("test"))


def fold_bounds(sizes: DataFrame, kind: str, **p: int) -> DataFrame:
    """Fold table per key: half-open row ranges of train and test (0-based).

    A fold is a filter on the row number; rows are never multiplied by the number of folds.
    ``kind``: walk_forward / expanding (initial, step, test), series (folds, test_pct),
    purged (folds, purge, embargo).
    """
    n = F.col("_n")
    if kind in ("walk_forward", "expanding"):
        last = F.floor((n - p["initial"] - p["test"]) / F.lit(p["step"]))
        f = sizes.where(n >= p["initial"] + p["test"]).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        pos = F.lit(p["initial"]) + F.col("fold") * p["step"]
        start = pos - p["initial"] if kind == "walk_forward" else F.lit(0).cast("long")
        return f.select("_key", "fold", start.alias("train_from"), pos.alias("train_to"), pos.alias("test_from"),
                        (pos + p["test"]).alias("test_to"))
    f = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p["folds"] - 1).cast("long"))))
    if kind == "series":
        total = F.floor(n * p["test_pct"] / 100)
        each = F.floor(total / p["folds"])
        a = n - total + F.col("fold") * each
        return f.select("_key", "fold", F.lit(0).cast("long").alias("train_from"), a.alias("train_to"), a.alias("test_from"),
                        F.least(a + each, n).alias("test_to")).where("test_to > test_from")
    size = F.floor(n / p["folds"])
    a, b = F.col("fold") * size, F.least((F.col("fold") + 1) * size, n)
    before, after = F.greatest(a - p["purge"], F.lit(0)), F.greatest(n - (b + p["embargo"]), F.lit(0))
    return f.select("_key", "fold", a.alias("test_from"), b.alias("test_to"), before.alias("train_before"), after.alias("train_after"),
                    (before + after).alias("train_rows"))


def fold_periods(o: Ordered, folds: DataFrame) -> DataFrame:
    """First and last time of train and test of each fold, by joining only the boundary rows."""
    ends = folds.select("_key", "fold", F.explode(F.array(
        *[F.struct(F.lit(name).alias("which"), (F.col(c) + d).alias("at")) for name, c, d in (
            ("train_start", "train_from", 1), ("train_end", "train_to", 0), ("test_start", "test_from", 1), ("test_end", "test_to", 0))])).alias("e"))
    ends = ends.select("_key", "fold", F.col("e.which").alias("which"), F.col("e.at").alias("_rn"))
    hit = o.rows.select("_key", "_rn", "ts").join(small_side(ends), ["_key", "_rn"])
    wide = hit.groupBy("_key", "fold").pivot("which", ["train_start", "train_end", "test_start", "test_end"]).agg(F.first("ts"))
    return folds.join(wide, ["_key", "fold"]).withColumn("leak", (F.col("train_end") >= F.col("test_start")).cast("int"))


def combinatorial_folds(o: Ordered, groups: int, held_out: int, purge: int, embargo: int) -> DataFrame:
    """Train and test sizes of every choice of ``held_out`` of ``groups`` blocks, purged and embargoed."""
    n = F.col("_n")
    g = o.with_size().groupBy("_key", F.floor((F.col("_rn") - 1) * groups / n).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    combos = list(combinations(range(groups), held_out))
    cases = F.array(*[F.struct(F.lit("-".join(map(str, c))).alias("name"), F.array(*map(F.lit, c)).alias("t")) for c in combos])
    x = g.withColumn("case", F.explode(cases))
    t, gi = F.col("case.t"), F.col("g").cast("int")
    test = F.array_contains(t, gi)
    cut = F.when(F.array_contains(t, gi - 1), embargo).otherwise(0) + F.when(F.array_contains(t, gi + 1), purge).otherwise(0)
    return x.groupBy("_key", F.col("case.name").alias("held_out")).agg(
        F.sum(F.when(test, F.col("c")).otherwise(0)).alias("test_rows"),
        F.sum(F.when(test, 0).otherwise(F.greatest(F.col("c") - cut, F.lit(0)))).alias("train_rows"))


def fit_scaler(train: DataFrame, cols: list[str], kind: str) -> DataFrame:
    """One row with centre and scale per column, from the training rows only."""
    if kind == "robust":
        long = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("r.*")
        q = exact_quantiles(long, ["feature"], "x", {"c": 0.5, "q1": 0.25, "q3": 0.75})
        pick = lambda c, x: F.max(F.when(F.col("feature") == c, x))
        return q.agg(*[f for c in cols for f in (pick(c, F.col("c")).alias(f"{c}_c"), pick(c, F.col("q3") - F.col("q1")).alias(f"{c}_s"))])
    centre, scale = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
    return train.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("c", centre), ("s", scale))])


def scale(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Apply a fitted scaler (a single row, so its broadcast is bounded)."""
    out = df.crossJoin(F.broadcast(fitted))
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"{c}_c")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")) for c in cols}
    return out.withColumns(scaled).drop(*[f"{c}_{n}" for c in cols for n in "cs"])


def encode(df: DataFrame, col: str, chunk_rows: int | None = None) -> DataFrame:
    """Label codes 0.. in value order; numbered over all tasks, not in one."""
    o = lay_out(df.select(col).distinct(), [], [col], chunk_rows)
    codes = o.rows.select(F.col(col), (F.col("_rn") - 1).alias(f"{col}_code"))
    return df.join(small_side(codes), col)


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return per.crossJoin(F.broadcast(total)).select(label_col, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def after_warmup(o: Ordered, warmup: int, latest: int | None = None) -> DataFrame:
    rows = o.with_size().where(F.col("_rn") > warmup)
    return rows.where(F.col("_rn") > F.col("_n") - latest) if latest else rows


def attach_means(ticks: DataFrame, book: DataFrame, cols: list[str]) -> DataFrame:
    """Mean book features on every tick (a single aggregated row)."""
    return ticks.crossJoin(F.broadcast(book.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])))
