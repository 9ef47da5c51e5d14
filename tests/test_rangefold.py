"""Range folds: the kernel, windows inside, over and far beyond chunks, extremes and drawdowns beside plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import risk
from tickloom.operators.ordered import lay_out, time_values
from tickloom.operators.rangefold import DRAWDOWN, GREATEST, LEAST, fold_runs, range_folds


def fall(p):
    peak = total = worst = None
    for x in p:
        if x is None:
            continue
        total = x if total is None else total + x
        peak = total if peak is None else max(peak, total)
        worst = max(worst or 0.0, peak - total)
    return worst


def test_kernel():
    rng = np.random.default_rng(4)
    p = rng.standard_normal(300)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(lo + rng.integers(-1, 120, 500), 299)
    got = fold_runs([p, p, p, np.zeros(300)], lo, hi, DRAWDOWN)[3]
    assert np.allclose(got, [fall(p[a:b + 1]) if b >= a else -np.inf for a, b in zip(lo, hi, strict=True)])
    assert fold_runs([p], lo, hi, LEAST)[0].tolist() == [p[a:b + 1].min() if b >= a else np.inf for a, b in zip(lo, hi, strict=True)]


@pytest.mark.parametrize("chunk", [4, 50, None])
def test_folds_over_chunks(spark, chunk):
    rnd = random.Random(6)
    rows = [(k, i, None if rnd.random() < 0.1 else rnd.gauss(0, 1), max(1, i - rnd.choice([0, 2, 9, 70]) + 1)) for k, n in (("hot", 130), (None, 20), ("one", 1)) for i in range(n)]
    t = spark.createDataFrame(rows, "symbol string, i long, x double, f long")
    first = F.when(F.col("i") % 13 != 5, F.col("f"))
    got = range_folds(lay_out(t, ["symbol"], ["i"], chunk), {"lo": (first, F.col("x"), LEAST), "hi": (F.lit(1), F.col("x"), GREATEST), "dd": (first, F.col("x"), DRAWDOWN)}).collect()
    assert len(got) == len(rows)
    xs = {(k, i): x for k, i, x, _ in rows}
    for r in got:
        window = lambda a: [x for j in range(a - 1, r.i + 1) if (x := xs[r.symbol, j]) is not None]  # noqa: B023, E731
        w = window(r.f)
        assert r.hi == max(window(1), default=None)
        assert (r.lo, r.dd) == (None, None) if r.i % 13 == 5 else r.lo == min(w, default=None)
        if r.i % 13 != 5:
            assert (r.dd is None) == (not w) and (not w or abs(r.dd - fall(w)) < 1e-9)


def test_time_extremes_do_not_copy_rows(spark):
    """A window longer than the data over chunks of 64, short windows, several reaches, integers and rows of equal times; no more rows after any step."""
    t = spark.range(1500).select(F.lit("k").alias("symbol"), F.timestamp_seconds((F.col("id") / 2).cast("long") * 60 + 1_700_000_000).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("v"))
    rows = sorted((r.ts, r.v) for r in t.collect())
    spec = {"lo": ("min", F.col("v"), 30 * 86400.0), "hi": ("max", F.col("v"), 300.0), "n": ("sum", F.lit(1), 300.0)}
    out = time_values(t, ["symbol"], "ts", spec, chunk_rows=64).orderBy("ts").collect()
    assert len(out) == 1500 and {r.lo for r in out[-5:]} == {min(v for _, v in rows)}
    for r in out[::37]:
        near = [v for at, v in rows if dt.timedelta(0) <= r.ts - at <= dt.timedelta(seconds=300)]
        assert (r.hi, r.n, r.lo) == (max(near), len(near), min(v for at, v in rows if at <= r.ts))


def test_rolling_drawdown_of_equal_times(spark):
    """Trades closed at the same time share their window and value, in chunks of 3."""
    rnd, t0 = random.Random(9), dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(minutes=5 * rnd.randint(0, 30)), i, 0, 1.0, float(rnd.randint(-9, 9))) for i in range(80)]
    got = risk.rolling_trades(spark.createDataFrame(rows, "regime string, exit_ts timestamp, trade_id long, leg int, quantity double, pnl double"), "regime", 3600, 3).collect()
    for r in got:
        w = [x[5] for x in sorted(rows, key=lambda x: x[1:]) if dt.timedelta(0) <= r.exit_ts - x[1] <= dt.timedelta(hours=1)]
        assert (r.n, r.max_drawdown) == (len(w), fall(w))
