"""Chunked windows equal plain ones, whatever the chunk size and the input order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.data import ticks
from tickloom.operators import flow, joins, rolling, scan
from tickloom.operators.ordered import exact_quantiles, lay_out, time_values

def plain():
    return Window.partitionBy("symbol").orderBy("ts", "seq")


def frame(df, *cols):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.fixture(params=[5, 64, None], ids=["chunk5", "chunk64", "default"])
def size(request):
    return request.param


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ticks()).repartition(3)


def test_row_numbers_follow_the_order(spark, size):
    d = spark.createDataFrame(ticks(null_key=True)).repartition(5)
    o = lay_out(d, ["symbol"], ["ts", "seq"], size)
    want = d.withColumn("n", F.row_number().over(plain()))
    got = {r.seq: r._rn for r in o.rows.select("seq", "_rn").collect()}
    assert got == {r.seq: r.n for r in want.select("seq", "n").collect()}


def test_row_frames_backward_and_forward(df, size):
    o = lay_out(df, ["symbol"], ["ts", "seq"], size)
    got = o.finish(o.chunked(12, 7).withColumns({
        "a": F.sum("quantity").over(o.frame(-12, 0)), "b": F.max("price").over(o.frame(-3, 7)), "c": F.lead("price", 7).over(o.window)}))
    want = df.withColumns({"a": F.sum("quantity").over(plain().rowsBetween(-12, 0)), "b": F.max("price").over(plain().rowsBetween(-3, 7)),
                           "c": F.lead("price", 7).over(plain())})
    cols = ("seq", "a", "b")
    assert frame(got, *cols) == frame(want, *cols)
    assert {r.seq: r.c for r in got.collect()} == {r.seq: r.c for r in want.collect()}


@pytest.mark.parametrize("seconds", [0, 3, 60, 100000])
def test_time_frames_count_rows_of_equal_time(df, size, seconds):
    got = time_values(df, ["symbol"], "ts", {"v": ("sum", F.col("quantity"), seconds), "m": ("max", F.col("price"), seconds)}, chunk_rows=size)
    w = Window.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    want = df.withColumns({"v": F.sum("quantity").over(w), "m": F.max("price").over(w)})
    assert frame(got, "seq", "v", "m") == frame(want, "seq", "v", "m")


def test_time_frames_with_one_instant_holding_most_rows(spark):
    pdf = ticks()
    pdf.loc[50:250, "ts"] = pdf["ts"].iloc[50]
    d = spark.createDataFrame(pdf)
    got = time_values(d, ["symbol"], "ts", {"v": ("sum", F.col("quantity"), 10)}, chunk_rows=5)
    w = Window.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(-10_000_000, 0)
    assert frame(got, "seq", "v") == frame(d.withColumn("v", F.sum("quantity").over(w)), "seq", "v")


def test_running_values(df, size):
    o = lay_out(df, ["symbol"], ["ts", "seq"], size)
    x = F.when(F.col("quantity") % 4 == 0, F.col("price"))
    got = o.running(o.chunked(), s=("sum", F.col("quantity")), hi=("max", F.col("price")), lo=("min", F.col("price")),
                    last=("last", x), prev=("before", x), nxt=("next", x))
    up, past, ahead = (plain().rowsBetween(Window.unboundedPreceding, 0), plain().rowsBetween(Window.unboundedPreceding, -1),
                       plain().rowsBetween(0, Window.unboundedFollowing))
    want = df.withColumns({"s": F.sum("quantity").over(up), "hi": F.max("price").over(up), "lo": F.min("price").over(up),
                           "last": F.last(x, ignorenulls=True).over(up), "prev": F.last(x, ignorenulls=True).over(past),
                           "nxt": F.first(x, ignorenulls=True).over(ahead)})
    pick = lambda d: {r.seq: (r.s, r.hi, r.lo, r.last, r.prev, r.nxt) for r in d.collect()}
    assert pick(got) == pick(want)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, size, p):
    pdf = ticks()
    got = {r.symbol: r.q for r in exact_quantiles(spark.createDataFrame(pdf), ["symbol"], "price", {"q": p}, size).collect()}
    want = pdf.groupby("symbol")["price"].quantile(p).to_dict()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_quantile_of_the_whole_table(spark, size):
    pdf = ticks()
    got = exact_quantiles(spark.createDataFrame(pdf), [], "quantity", {"q": 0.3}, size).first().q
    assert abs(got - pdf["quantity"].quantile(0.3)) < 1e-9


def test_recurrence_equals_pandas(spark, size):
    pdf = ticks()
    o = lay_out(spark.createDataFrame(pdf), ["symbol"], ["ts", "seq"], size)
    got = {r.seq: r.ema_9 for r in scan.ema_ticks(o, F.col("price"), 9, ["seq"]).collect()}
    want = pdf.groupby("symbol")["price"].transform(lambda s: s.ewm(span=9, adjust=False).mean())
    assert max(abs(got[s] - w) for s, w in zip(pdf["seq"], want)) < 1e-9


def test_streaks_equal_brute_force(spark, size):
    pdf = ticks()
    got = {r.seq: r.length for r in rolling.streaks(spark.createDataFrame(pdf), F.col("side"), size).collect()}
    for _, g in pdf.groupby("symbol"):
        last, n = object(), 0
        for s, side in zip(g["seq"], g["side"]):
            n = n + 1 if side == last else 1
            last = side
            assert got[s] == n


@pytest.mark.parametrize("direction", ["backward", "nearest"])
def test_asof_equals_merge_asof(spark, size, direction):
    left, right = ticks(200, 5), ticks(150, 9)
    right = right.drop_duplicates(["symbol", "ts"], keep="last")
    got = joins.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], ["price"], direction=direction,
                     tolerance=30, chunk_rows=size)
    got = {r.seq: r.r_price for r in got.collect()}
    want = pd.merge_asof(left.sort_values("ts"), right[["symbol", "ts", "price"]].sort_values("ts"), on="ts", by="symbol",
                         direction=direction, tolerance=pd.Timedelta("30s"), suffixes=("", "_r"))
    assert got == {s: (None if np.isnan(p) else p) for s, p in zip(want["seq"], want["price_r"])}


def test_recent_equals_pairs(spark, size):
    left, right = ticks(80, 5), ticks(90, 9)
    got = joins.recent(spark.createDataFrame(left), spark.createDataFrame(right), ["symbol"], 25, {"v": F.col("quantity")}, chunk_rows=size)
    got = {r.seq: r.v for r in got.collect()}
    for l in left.itertuples():
        near = right[(right.symbol == l.symbol) & (right.ts <= l.ts) & (right.ts >= l.ts - pd.Timedelta("25s"))]
        assert got[l.seq] == near.quantity.sum()


def test_no_look_ahead(spark):
    pdf = ticks()
    cut = pdf["ts"].iloc[200]
    other = pdf.copy()
    other.loc[other["ts"] > cut, "price"] = 1.0
    other.loc[other["ts"] > cut, "side"] = "buy"
    run = lambda p: {r.seq: tuple(r) for r in flow.flow_counts(spark.createDataFrame(p), 16).select(
        "seq", "volume_imbalance", "aggression", "flow_momentum", "flow_imbalance").collect()}
    a, b = run(pdf), run(other)
    assert all(a[s] == b[s] for s in pdf.loc[pdf["ts"] <= cut, "seq"])


def test_partitioning_does_not_matter(spark):
    pdf = ticks()
    run = lambda d: frame(rolling.cumulative(d, 20), "seq", "cvd", "obv", "vwap")
    assert run(spark.createDataFrame(pdf).coalesce(1)) == run(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(9))
