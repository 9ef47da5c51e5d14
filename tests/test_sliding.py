"""Sliding order statistics and frequencies beside plain frames."""

import statistics
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.data import ticks
from tickloom.operators import rolling as ro
from tickloom.operators.ordered import lay_out
from tickloom.operators.sliding import add_sliding


def plain(values, kind, start, end, minimum):
    out = []
    for j, x in enumerate(values):
        frame = values[max(0, j + start):max(0, j + end + 1)]
        seen = [v for v in frame if v is not None]
        c, n = Counter(seen), len(seen)
        if kind == "distinct":
            out.append(len(c) if len(frame) >= minimum else None)
        elif kind == "median":
            out.append(statistics.median(seen) if n and n >= minimum else None)
        elif kind == "rank":
            less, equal = sum(v < x for v in seen if x is not None), sum(v == x for v in seen)
            out.append((less + (equal + 1) / 2) / n if x is not None and n >= minimum else None)
        elif not n or len(frame) < minimum:
            out.append(None)
        else:
            out.append(sum((k / n) ** 2 for k in c.values()) if kind == "hhi" else max(c.values()) / n)
    return out


@pytest.mark.parametrize("n", [1, 5, 40])
def test_frames_equal_plain_ones(spark, n):
    """Tiny chunks, nulls in the values and in the key, ties, frames longer than most keys."""
    t = ticks(260, null_key=True)
    t["x"] = [None if i % 9 == 0 else round(p) for i, p in enumerate(t.price)]
    none = lambda x: None if x is None or x != x else x
    rows = [(none(r.symbol), r.ts.to_pydatetime(), r.seq, r.price, r.quantity, r.side, r.buy_agent, r.sell_agent, none(r.x)) for r in t.itertuples()]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, quantity long, side string, buy_agent long, sell_agent long, x double")
    spec = {"median": ("median", "x", 1 - n, 0, 1), "whole": ("median", "x", 1 - n, 0, n), "rank": ("rank", "x", 1 - n, 0, 1), "distinct": ("distinct", "x", 1 - n, 0, 0),
            "hhi": ("hhi", "x", -n, -1, n), "share": ("top_share", "x", -n, -1, 1), "late": ("hhi", "buy_agent", -n, -1, 1), "kinds": ("distinct", "side", -n, -1, n)}
    o = lay_out(df, ["symbol"], ["ts", "seq"], 7)
    got = {r.seq: r for r in add_sliding(o.chunked(before=n), spec).collect()}
    assert len(got) == 260
    for key in ("hot", "a", "b", None):
        rows = [r for r in t.itertuples() if (r.symbol == key if key else r.symbol is None or r.symbol != r.symbol)]
        for name, (kind, col, start, end, minimum) in spec.items():
            values = [none(getattr(r, col)) for r in rows]
            for r, want in zip(rows, plain(values, kind, start, end, minimum)):
                have = got[r.seq][name]
                assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-12), (key, name, r.seq, have, want)


def test_not_a_number_and_empty_tables(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(6), "x": [3.0, 1.0, float("nan"), 2.0, 2.0, 5.0]})).withColumn("x", F.when(F.col("x").isNull(), float("nan")).otherwise(F.col("x")))
    spec = {"median": ("median", "x", -2, 0, 3), "rank": ("rank", "x", -2, 0, 3)}
    rows = add_sliding(lay_out(df, ["k"], ["i"], 2).chunked(before=2), spec).orderBy("i").collect()
    assert [r.median for r in rows] == [None, None, 3.0, 2.0, 2.0, 2.0] and [r.rank for r in rows][2:] == [1.0, 2 / 3, 0.5, 1.0]
    assert add_sliding(lay_out(df.limit(0), ["k"], ["i"], 2).chunked(before=2), spec).count() == 0


def test_long_frames_cost_no_more_than_short_ones(spark):
    """200,000 rows: 10,000 rows a frame give the right values, in about the time of 10 rows."""
    df = spark.range(200_000).select(F.lit("k").alias("symbol"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), (F.hash("id") % 5000).cast("double").alias("price"),
                                     F.lit(1).alias("quantity"), F.pmod(F.xxhash64("id"), F.lit(700)).alias("buy_agent"))
    o = lay_out(df, ["symbol"], ["ts", "seq"], 50_000)
    took = {}
    for n in (10, 10_000):
        spec = {"median": ("median", "price", 1 - n, 0, n), "rank": ("rank", "price", 1 - n, 0, n), "buyers": ("distinct", "buy_agent", 1 - n, 0, 0), "hhi": ("hhi", "buy_agent", -n, -1, n)}
        t = time.time()
        out = add_sliding(o.chunked(before=n), spec).select("seq", *spec).toPandas().sort_values("seq")
        took[n] = time.time() - t
    base = df.toPandas()
    for at in (9_999, 10_000, 123_456, 199_999):
        frame, row = base.iloc[at - 9_999:at + 1], out.iloc[at]
        x = base.price[at]
        assert row["median"] == np.median(frame.price) and row["buyers"] == frame.buy_agent.nunique()
        assert abs(row["rank"] - ((frame.price < x).sum() + ((frame.price == x).sum() + 1) / 2) / 10_000) < 1e-12
        if at >= 10_000:
            assert abs(row["hhi"] - ((base.buy_agent[at - 10_000:at].value_counts() / 10_000) ** 2).sum()) < 1e-12
    assert took[10_000] < 5 * took[10] + 5


def test_rolling_queries_hold_no_arrays(spark):
    """No frame collects its values, so a row costs the same however long its frame is."""
    df = spark.createDataFrame(ticks(50))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for out in (ro.rolling_stats(df, 20), ro.rolling_agents(df, 20)):
        plan = out._jdf.queryExecution().explainString(mode)
        assert "collect_list" not in plan and "collect_set" not in plan and "percentile" not in plan
