"""Data quality: rules, scores, gaps, fills, reconciliation, anomaly detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import market_open, repaired_ohlc
from tickloom.operators import dedupe
from tickloom.operators.history import grid
from tickloom.operators.ordered import exact_quantiles, lay_out
from tickloom.operators.windows import corr
from tickloom.session import small_side


@dataclass(frozen=True)
class Rule:
    """A named check: an aggregate per key that must not exceed ``limit``; optionally a fix."""

    name: str
    metric: Column
    limit: float
    severity: str = "warning"
    fix: Callable[[DataFrame], DataFrame] | None = None


def check(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per key and rule: metric, passed, and the points it gives (1, 0.5 or 0)."""
    wide = df.groupBy(*keys).agg(*[r.metric.cast("double").alias(f"m{i}") for i, r in enumerate(rules)])
    rows = F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"m{i}").alias("metric"),
        (F.col(f"m{i}") <= r.limit).alias("passed")) for i, r in enumerate(rules)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").withColumn(
        "points", F.when(F.col("passed"), 1.0).when(F.col("severity") == "error", 0.0).otherwise(0.5))


def score(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.groupBy(*keys).agg(
        F.avg("points").alias("score"),
        F.sum((~F.col("passed") & (F.col("severity") == "error")).cast("int")).alias("errors"),
        F.sum((~F.col("passed") & (F.col("severity") == "warning")).cast("int")).alias("warnings"))


def apply_fixes(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return reduce(lambda d, r: r.fix(d) if r.fix else d, rules, df)


def prepared(ticks: DataFrame, tie: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Ticks with gap to the previous row, repetition flag and outlier flag (3 IQR, exact quartiles)."""
    q = exact_quantiles(ticks, ["symbol"], "price", {"q1": 0.25, "q3": 0.75}, chunk_rows)
    o = lay_out(ticks.join(small_side(q), "symbol", "left"), ["symbol"], ["ts", *tie], chunk_rows)
    us = F.unix_micros("ts")
    iqr = F.col("q3") - F.col("q1")
    rows = o.chunked(before=1).withColumns({
        "gap": (us - F.lag(us).over(o.window)) / 1e6,
        "repeated": F.coalesce((us == F.lag(us).over(o.window)).cast("int"), F.lit(0)),
        "outlier": F.coalesce(((F.col("price") < F.col("q1") - 3 * iqr) | (F.col("price") > F.col("q3") + 3 * iqr)).cast("int"), F.lit(0))})
    return o.finish(rows)


def tick_rules() -> list[Rule]:
    n = F.count(F.lit(1))
    share = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0))) / n
    return [
        Rule("missing", share(F.col("price").isNull()), 0.01, "warning"),
        Rule("duplicates", F.sum("repeated") / n, 0.001, "error"),
        Rule("outliers", F.sum("outlier") / n, 0.001),
        Rule("max_gap_minutes", F.max("gap") / 60, 120.0, "error"),
        Rule("outside_hours", share(~market_open(F.col("ts"))), 0.01),
        Rule("non_positive", F.sum(F.coalesce((F.col("price") <= 0).cast("int"), F.lit(0))), 0.0, "error")]


def bar_rules() -> list[Rule]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    count = lambda x: F.sum(F.coalesce(x.cast("int"), F.lit(0)))
    return [
        Rule("ohlc", count(h < F.greatest(o, l, c)) + count(l > F.least(o, h, c)), 0.0, "error",
             lambda d: d.withColumns(repaired_ohlc())),
        Rule("price_gaps", count(F.col("gap_pct") > 0.02) / F.count(F.lit(1)), 0.01),
        Rule("low_trades", -F.avg("trades"), -3.0)]


def with_price_gap(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts")
    pc = F.lag("close").over(w)
    return bars.withColumn("gap_pct", F.abs(F.col("open") - pc) / pc)


def fixed_ticks(ticks: DataFrame, tie: list[str], chunk_rows: int | None = None) -> DataFrame:
    """Keep the last row per time, blank bad prices, fill forward then backward."""
    one = dedupe.keep(ticks, ["symbol", "ts"], tie, last=True)
    good = one.withColumn("price", F.when(F.col("price") > 0, F.col("price")))
    o = lay_out(good, ["symbol"], ["ts"], chunk_rows)
    out = o.running(o.chunked(), _p=("last", F.col("price")), _n=("next", F.col("price")))
    return out.withColumn("price", F.coalesce("_p", "_n")).select(*good.columns)


def partition_score(ticks: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Quality score of each (symbol, day): missing, duplicate, outlier, few rows, short span."""
    t = ticks.withColumn("day", F.to_date("ts"))
    q = exact_quantiles(t, ["symbol", "day"], "price", {"q1": 0.25, "q3": 0.75}, chunk_rows)
    iqr = F.col("q3") - F.col("q1")
    t = t.join(small_side(q), ["symbol", "day"], "left").withColumn("_out", F.coalesce(
        ((F.col("price") < F.col("q1") - 3 * iqr) | (F.col("price") > F.col("q3") + 3 * iqr)).cast("int"), F.lit(0)))
    per_ts = t.groupBy("symbol", "day", "ts").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("price").isNull().cast("int")).alias("m"), F.sum("_out").alias("o"))
    g = per_ts.groupBy("symbol", "day").agg(
        F.sum("c").alias("n"), (F.sum("m") / F.sum("c")).alias("missing"),
        (F.sum(F.col("c") - 1) / F.sum("c")).alias("duplicates"), (F.sum("o") / F.sum("c")).alias("outliers"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("hours"))
    s = (F.when(F.col("missing") > 0.01, 1 - F.col("missing")).otherwise(1.0)
         * (1 - F.col("duplicates") * 2) * F.when(F.col("outliers") > 0.001, 0.9).otherwise(1.0)
         * F.when(F.col("n") < 100, 0.5).otherwise(1.0) * F.when(F.col("hours") < 6, 0.8).otherwise(1.0))
    return g.withColumn("score", s)


def continuity(ticks: DataFrame, max_gap: float) -> DataFrame:
    """Gap and overlap between consecutive daily partitions of a symbol."""
    w = Window.partitionBy("symbol").orderBy("day")
    p = ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    gap = (F.unix_micros("first") - F.lag(F.unix_micros("last")).over(w)) / 1e6
    return p.withColumn("gap", gap).withColumn("status", F.when(F.col("gap").isNull(), "start").when(F.col("gap") < 0, "overlap").when(
        F.col("gap") > max_gap, "gap").otherwise("continuous"))


def gap_list(ticks: DataFrame, seconds: float, chunk_rows: int | None = None) -> DataFrame:
    """Every pause longer than ``seconds`` with its ends."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    rows = o.chunked(before=1).withColumn("start", F.lag("ts").over(o.window))
    rows = rows.withColumn("gap", (F.unix_micros("ts") - F.unix_micros("start")) / 1e6)
    return o.finish(rows.where(F.col("gap") > seconds), "symbol", "start", F.col("ts").alias("end"), "gap")


def continuity_score(ticks: DataFrame, seconds: float, chunk_rows: int | None = None) -> DataFrame:
    gaps = gap_list(ticks, seconds, chunk_rows).groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("longest"))
    n = ticks.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return n.join(gaps, "symbol", "left").select(
        "symbol", "rows", F.coalesce("gaps", F.lit(0)).alias("gaps"), "longest",
        (1 - F.coalesce("gaps", F.lit(0)) / F.col("rows")).alias("continuity"))


def regular_grid(bars: DataFrame, minutes: int) -> DataFrame:
    """Full time grid with carried and with linearly interpolated closes."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    g = grid(bars.select("symbol", "ts", "close"), minutes)
    at = F.when(F.col("close").isNotNull(), F.struct(F.col("close").alias("v"), F.unix_seconds("ts").alias("t")))
    g = g.withColumns({"_p": F.last(at, ignorenulls=True).over(back), "_n": F.last(at, ignorenulls=True).over(ahead)})
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.unix_seconds("ts") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    return g.select("symbol", "ts", "real", F.col("_p.v").alias("carried"),
                    F.when(F.col("close").isNotNull(), F.col("close")).otherwise(line).alias("interpolated"))


#: Strategies of ``handle_nulls``: what to do with the nulls of a bar column.
STRATEGIES = ("ffill", "bfill", "interpolate", "zero", "drop")


def handle_nulls(bars: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Fill (or drop on) nulls of bar columns, each by its own strategy."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    out, drops = bars.withColumn("_i", F.row_number().over(w)), []
    cols = {}
    for c, how in plan.items():
        x = F.col(c)
        p, n = F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)
        if how == "ffill":
            cols[c] = p
        elif how == "bfill":
            cols[c] = n
        elif how == "zero":
            cols[c] = F.coalesce(x, F.lit(0))
        elif how == "interpolate":
            at = F.when(x.isNotNull(), F.col("_i"))
            pi, ni = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
            cols[c] = F.coalesce(x, p + (n - p) * (F.col("_i") - pi) / (ni - pi), p)
        elif how == "drop":
            drops.append(c)
        else:
            raise ValueError(f"unknown strategy {how}")
    out = out.withColumns(cols).drop("_i")
    return out.na.drop(subset=drops) if drops else out


def null_report(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    def nulls(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("k")) for c in cols])).alias("r")
                           ).select(F.col("r.feature").alias("feature"), F.col("r.k").alias(name))
    return nulls(before, "nulls_before").join(nulls(after, "nulls_after"), "feature")


# Neutral fill of columns recognised by their name.
NEUTRAL = {"rsi": 50.0, "adx": 15.0, "momentum": 0.0, "volume": 0.0}


# Parts of the names of ratio columns.
RATIOS = ("ratio", "pct", "percent", "imbalance")


def smart_fill(bars: DataFrame, cols: list[str]) -> DataFrame:
    """Fill by kind of column: prices carried both ways, ratios interpolated at most five rows and then carried
    forward and backward, others neutral.  Columns without any value stay null."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    out = bars.withColumn("_i", F.row_number().over(w))
    fills = {}
    ratios = [c for c in cols if any(r in c for r in RATIOS) and not any(k in c for k in NEUTRAL)]
    for c in cols:
        x = F.col(c)
        p, n = F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)
        neutral = [v for k, v in NEUTRAL.items() if k in c]
        if neutral:
            fills[c] = F.coalesce(x, F.lit(neutral[0]))
        elif c in ratios:
            at = F.when(x.isNotNull(), F.col("_i"))
            pi, ni = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
            fills[c] = F.when(x.isNotNull(), x).when(F.col("_i") - pi <= 5, p + (n - p) * (F.col("_i") - pi) / (ni - pi))
        else:
            fills[c] = F.coalesce(p, n)
    out = out.withColumns(fills)
    rest = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)) for c in ratios}
    return (out.withColumns(rest) if rest else out).drop("_i")


def zero_share(filled: DataFrame, cols: list[str], most: float = 0.3) -> DataFrame:
    """Check after filling: share of zeros of each column and symbol, and whether it is above ``most``."""
    long = filled.select("symbol", F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])).alias("name", "value"))
    out = long.groupBy("symbol", "name").agg(F.avg((F.col("value") == 0).cast("double")).alias("zeros"))
    return out.withColumn("suspicious", F.coalesce((F.col("zeros") > most).cast("int"), F.lit(0)))


def synthetic_signs(ticks: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Signs of made-up data: too even volumes and intervals, repeated steps, one dominant value."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    w = o.window
    t = o.finish(o.chunked(before=2).withColumns({
        "d": F.round(F.col("price") - F.lag("price").over(w), 2),
        "g": (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6, "prev": F.lag("price").over(w)}))
    steps = t.where("d IS NOT NULL").groupBy("symbol", "d").agg(F.count(F.lit(1)).alias("c")).groupBy("symbol").agg(
        (F.count(F.lit(1)) / F.sum("c")).alias("unique_steps"))
    top = t.groupBy("symbol", "quantity").agg(F.count(F.lit(1)).alias("c")).groupBy("symbol").agg(
        (F.max("c") / F.sum("c")).alias("top_share"))
    base = t.groupBy("symbol").agg(
        (F.stddev_samp("quantity") / F.avg("quantity")).alias("volume_cv"), (F.stddev_samp("g") / F.avg("g")).alias("interval_cv"),
        corr(F.col("price"), F.col("prev")).alias("autocorr"))
    j = base.join(steps, "symbol").join(top, "symbol")
    return j.withColumn("signs", F.concat_ws(",", F.when(F.col("volume_cv") < 0.15, "even_volume"), F.when(
        F.col("unique_steps") < 0.7, "repeated_steps"), F.when(F.col("interval_cv") < 0.1, "even_intervals"), F.when(
        F.col("top_share") > 0.2, "dominant_value"), F.when(F.abs("autocorr") > 0.95, "autocorrelated")))


def bar_signs(bars: DataFrame, least_cv: float = 0.001, off: float = 0.3) -> DataFrame:
    """Two more signs, over bars: spreads that hardly vary, and volumes whose runs above and below the median are not random.

    Spreads are (high - low) / close where positive; without any there is no such sign.  A random series of n bars has
    about n / 2 runs (a bar at the median counts as below); with more than 10 bars, a number further than the share ``off`` from
    that is a sign.  Null volumes are left out of the runs.
    """
    held = bars.where(F.col("volume").isNotNull())
    med = held.groupBy("symbol").agg(F.percentile("volume", 0.5).alias("_med"))
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = held.join(small_side(med), "symbol").withColumn("_above", F.col("volume") > F.col("_med"))
    turned = rows.withColumn("_turn", F.coalesce((F.lag("_above").over(w) != F.col("_above")).cast("long"), F.lit(0)))
    runs = turned.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), (F.sum("_turn") + 1).alias("runs"))
    spread = F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    cv = bars.withColumn("_s", F.when(spread > 0, spread)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.try_divide(F.stddev_samp("_s"), F.avg("_s")).alias("spread_cv"))
    j = cv.join(runs, "symbol", "left").withColumn("runs_off", F.try_divide(F.abs(F.col("runs") - F.col("_n") / 2), F.col("_n") / 2))
    return j.withColumn("signs", F.concat_ws(",", F.when(F.col("spread_cv") < least_cv, "even_spread"), F.when(
        (F.col("_n") > 10) & (F.col("runs_off") > off), "volume_runs"))).drop("_n")


def constant_runs(ticks: DataFrame, value: Column, chunk_rows: int | None = None) -> DataFrame:
    """Longest run of one value, as share of the rows; zero and null counts."""
    o = lay_out(ticks.withColumn("_x", value), ["symbol"], ["ts", "seq"], chunk_rows)
    rows = o.chunked(before=1)
    rows = rows.withColumn("_ch", (~F.lag("_x").over(o.window).eqNullSafe(F.col("_x"))) | (F.col("_rn") == 1))
    out = o.running(rows, _from=("max", F.when(F.col("_ch"), F.col("_rn"))))
    g = out.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("_rn") - F.col("_from") + 1).alias("longest"),
        F.sum((F.col("_x") == 0).cast("int")).alias("zeros"), F.sum(F.col("_x").isNull().cast("int")).alias("nulls"))
    return g.withColumn("suspicious", (F.col("longest") > F.col("rows") * 0.1).cast("int"))


def feature_report(df: DataFrame, cols: list[str], high: float = 0.95) -> DataFrame:
    """Per column: nulls, infinities, constancy, variance, and how many others it duplicates."""
    n = F.count(F.lit(1))
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        ok = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        parts += [F.sum((x.isNull() | F.isnan(x)).cast("long")).alias(f"{c}_nan"),
                  F.sum((F.abs(x) == float("inf")).cast("long")).alias(f"{c}_inf"), F.var_samp(ok).alias(f"{c}_var"),
                  (F.max(ok) == F.min(ok)).cast("int").alias(f"{c}_const")]
    pairs = list(combinations(cols, 2))
    parts += [corr(F.col(a), F.col(b)).alias(f"corr{i}") for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*parts)
    strong = lambda c: sum((F.coalesce((F.abs(f"corr{i}") > high).cast("int"), F.lit(0)) for i, p in enumerate(pairs) if c in p), F.lit(0))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_nan").alias("nans"), F.col(f"{c}_inf").alias("infs"),
                              F.col(f"{c}_var").alias("variance"), F.col(f"{c}_const").alias("constant"), strong(c).alias("duplicates"))
                     for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def container_score(bars: DataFrame, micro: DataFrame, minutes: int) -> DataFrame:
    """Gaps, bars without microstructure, broken OHLC and nulls per symbol; 100 less ten per issue."""
    w = Window.partitionBy("symbol").orderBy("ts")
    b = bars.withColumn("_gap", (F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(w)) > minutes * 60)
    lone = bars.join(micro.select("symbol", "ts"), ["symbol", "ts"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("lone"))
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    g = b.groupBy("symbol").agg(F.sum(F.coalesce(F.col("_gap").cast("int"), F.lit(0))).alias("gaps"), F.sum(bad.cast("int")).alias("bad_ohlc"),
                                F.sum(F.col("close").isNull().cast("int")).alias("nulls")).join(lone, "symbol", "left").na.fill({"lone": 0})
    issues = sum(((F.col(c) > 0).cast("int") for c in ("gaps", "bad_ohlc", "nulls", "lone")), F.lit(0))
    return g.withColumn("score", F.greatest(100 - 10 * issues, F.lit(0)))


def file_integrity(df: DataFrame, value: str) -> DataFrame:
    """Rows, nulls and non-positive values per source file, and a verdict."""
    g = df.select(F.col("_metadata.file_name").alias("file"), F.col(value).alias("x")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("x").isNull().cast("int")).alias("nulls"),
        F.sum(F.coalesce((F.col("x") <= 0).cast("int"), F.lit(0))).alias("bad"))
    return g.withColumn("status", F.when(F.col("rows") == 0, "empty").when(
        (F.col("nulls") + F.col("bad")) / F.col("rows") > 0.1, "corrupt").otherwise("ok"))


def counter_check(ticks: DataFrame, counter: str, delta: str, chunk_rows: int | None = None) -> DataFrame:
    """Steps of a cumulative counter against the reported deltas."""
    o = lay_out(ticks, ["symbol"], ["ts", "seq"], chunk_rows)
    rows = o.chunked(before=1).withColumn("_step", F.col(counter) - F.lag(counter).over(o.window)).where("_own")
    return rows.groupBy("symbol").agg(
        F.count("_step").alias("steps"), F.sum((F.col("_step") < 0).cast("int")).alias("backward"),
        F.sum((F.col("_step") != F.col(delta)).cast("int")).alias("mismatched"))


def clip_outliers(df: DataFrame, keys: list[str], col: str, factor: float = 3.0, method: str = "iqr") -> DataFrame:
    """Values pulled to the limits of ``factor`` IQRs around the exact quartiles, or of that many deviations."""
    if method == "iqr":
        q = exact_quantiles(df, keys, col, {"_q1": 0.25, "_q3": 0.75})
        iqr = F.col("_q3") - F.col("_q1")
        lim = q.select(*keys, (F.col("_q1") - factor * iqr).alias("_lo"), (F.col("_q3") + factor * iqr).alias("_hi"))
    else:
        m, s = F.avg(col), F.stddev_samp(col)
        lim = df.groupBy(*keys).agg((m - factor * s).alias("_lo"), (m + factor * s).alias("_hi"))
    x = F.col(col)
    return df.join(small_side(lim), keys).withColumn(f"{col}_clipped", F.when(
        x < F.col("_lo"), F.col("_lo")).when(x > F.col("_hi"), F.col("_hi")).otherwise(x)).drop("_lo", "_hi")


def diagnostics(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Null share, variance, mean absolute z, correlation with the target and rank, per column."""
    first = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    n = F.count(F.lit(1))
    parts = []
    for c in cols:
        parts += [(1 - F.count(c) / n).alias(f"{c}_null"), F.var_samp(c).alias(f"{c}_var"),
                  F.avg(F.abs(F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")))).alias(f"{c}_z"),
                  corr(F.col(c), F.col(target)).alias(f"{c}_corr")]
    wide = df.crossJoin(F.broadcast(first)).agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_null").alias("null_share"), F.col(f"{c}_var").alias("variance"),
                              F.col(f"{c}_z").alias("mean_abs_z"), F.col(f"{c}_corr").alias("target_corr")) for c in cols])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def required_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Presence, nulls and usability of the features a model needs."""
    have = [c for c in names if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in have])
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.lit(int(c in have)).alias("present"),
        ((F.col("_n") - F.col(c)) if c in have else F.lit(None).cast("long")).alias("nulls")) for c in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "usable", ((F.col("present") == 1) & (F.col("nulls") == 0)).cast("int"))


def reconcile(ticks: DataFrame, bars: DataFrame, width: str, price_tol: float, volume_tol: float) -> DataFrame:
    """Do the ticks of each bar reproduce its extremes and volume?"""
    t = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.max("price").alias("t_hi"), F.min("price").alias("t_lo"), F.sum("quantity").alias("t_vol"),
    ).select("symbol", F.col("w.start").alias("ts"), "t_hi", "t_lo", "t_vol", F.lit(1).alias("found"))
    near = lambda a, b, tol: F.abs(F.col(a) - F.col(b)) / F.col(b) <= tol
    j = bars.join(t, ["symbol", "ts"], "left").select(
        "symbol", F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce(near("t_hi", "high", price_tol) & near("t_lo", "low", price_tol), F.lit(False)).cast("int").alias("p"),
        F.coalesce(near("t_vol", "volume", volume_tol), F.lit(False)).cast("int").alias("v"))
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("found").alias("matched"), F.sum("p").alias("price_ok"),
        F.sum("v").alias("volume_ok"), (F.sum(F.col("p") * F.col("v")) / F.count(F.lit(1))).alias("score"))
