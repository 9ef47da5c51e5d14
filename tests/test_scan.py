"""Smoothing by scans of affine maps: kinds, gaps, tiny chunks, groups of chunks; beside plain loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import test_queries
from tickloom.operators import scan
from tests.test_queries import con, plan  # noqa: F401  (a fixture)

SMOOTHED = ["w20_w21_smoothing", "t01_ema_set", "t03_rsi_variants", "t04_macd", "t07_atr", "t08_adx", "t09_composite", "t25_composite_flags", "t31_dynamic_macd",
            "r01_r02_regimes", "r04_trend_flags", "r10_trend_confirmation", "w19_ema_ticks"]


def test_kernel():
    """Any factors, also zero, over block edges."""
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        a, b = rng.choice([0.0, 1.0, 0.9, -0.5], (n, 3), p=[0.05, 0.2, 0.55, 0.2]), rng.standard_normal((n, 3))
        y, out = np.full(3, 7.0), []
        for t in range(n):
            y = a[t] * y + b[t]
            out.append(y)
        fa, fb = scan.affine_scan(a, b)
        assert np.allclose(fa * 7.0 + fb, out, atol=1e-9)


def plain(x: pd.Series, kind: str, p: int) -> pd.Series:
    if kind == "ema":
        return x.ewm(span=p, adjust=False).mean()
    if kind == "ema_adjust":
        return x.ewm(span=p, min_periods=p).mean()
    out, y, seen = [], None, []
    if kind == "wilder":
        for v in x:
            if np.isnan(v):
                out.append(np.nan)
                continue
            seen.append(v)
            y = y + (v - y) / p if len(seen) > p else sum(seen) / p if len(seen) == p else None
            out.append(np.nan if y is None else y)
        return pd.Series(out)
    mean = x.rolling(p, min_periods=1).mean()
    tail = x.iloc[2 * p - 1:].copy()
    if len(tail):
        tail.iloc[0] = mean.iloc[2 * p - 1]
        mean.iloc[2 * p - 1:] = tail.ewm(alpha=1 / p, adjust=False).mean()
    return mean


@pytest.mark.parametrize("chunk,fan", [(7, 4), (64, 1024), (None, 1024)])
def test_kinds_with_gaps(spark, monkeypatch, chunk, fan):
    """Missing values at starts, in runs longer than a chunk, NaN, a null key, a key of one row; chunks composed over three levels."""
    monkeypatch.setattr(scan, "FAN", fan)
    rnd, rows, t0 = random.Random(5), [], dt.datetime(2024, 1, 1)
    for key, n in (("hot", 240), (None, 60), ("one", 1), ("short", 9)):
        for i in range(n):
            v = None if i < 3 and key == "hot" or 100 <= i < 125 or rnd.random() < 0.1 else float("nan") if rnd.random() < 0.05 else 100 + rnd.gauss(0, 5)
            rows.append((key, t0 + dt.timedelta(minutes=i), v))
    rnd.shuffle(rows)
    steps = [("ema", "x", "ema", 9), ("adj", "x", "ema_adjust", 5), ("wil", "x", "wilder", 6), ("late", "x", "wilder_late", 5),
             ("gap", F.col("ema") - F.col("wil"), "expr", 0), ("chain", "gap", "ema", 4), ("more", "chain", "ema", 3)]
    got = scan.smooth(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), ["symbol"], "ts", steps, chunk).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("symbol", dropna=False):
        g = g.sort_values("ts").reset_index(drop=True)
        x = g["x"].astype(float)
        want = {k: plain(x, kind, p) for k, kind, p in (("ema", "ema", 9), ("adj", "ema_adjust", 5), ("wil", "wilder", 6), ("late", "wilder_late", 5))}
        want["gap"] = want["ema"] - want["wil"]
        want["chain"] = plain(want["gap"], "ema", 4)
        want["more"] = plain(want["chain"], "ema", 3)
        for name, w in want.items():
            assert np.allclose(g[name].astype(float), w, atol=1e-9, equal_nan=True), name


@pytest.mark.parametrize("name", SMOOTHED)
def test_smoothed_queries_across_chunk_edges(spark, sf, con, name):  # noqa: F811
    test_queries.test_values_across_chunk_edges(spark, sf, con, name)


def test_no_group_holds_a_whole_key(spark):
    """The only grouped steps are by key and chunk, or by key and group of chunks."""
    t = spark.range(1000).select(F.lit("k").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("x"))
    text = plan(scan.smooth(t, ["symbol"], "ts", [("e", "x", "ema", 9), ("s", F.col("e") * 2, "expr", 0), ("z", "s", "ema", 3)], 64))
    groups = [line for line in text.splitlines() if "FlatMapGroupsInArrow" in line and "Arguments" not in line]
    assert groups and "FlatMapGroupsInPandas" not in text
    for line in text.splitlines():
        if "hashpartitioning" in line:
            assert "chunk" in line or "_group" in line or "_seg" in line, line
