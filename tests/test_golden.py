"""Golden values of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as fc
from tickloom.operators import aggregates as ag, bars, book, cleaning, dataset, evaluate, quality, risk, scan
from tickloom.operators.windows import by_time, pct_change

T0 = dt.datetime(2024, 1, 2, 10)


def series(spark, closes, volume=None):
    rows = [("x", T0 + dt.timedelta(minutes=i), float(c), c + 3.0, c - 7.0, float(c), (volume or [1000] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume long")


def test_returns(spark):
    got = [r.r for r in series(spark, [100, 102, 101, 103, 105, 104, 106]).select(
        "ts", pct_change(F.col("close"), by_time("symbol")).alias("r")).orderBy("ts").collect() if r.r is not None]
    assert len(got) == 6 and got[0] == pytest.approx(0.02)


def test_candle_statistics(spark):
    b = series(spark, [102, 103, 104, 105, 106], [1000, 2000, 3000, 4000, 5000])
    last = ag.candle_buffer(b, 5).orderBy(F.desc("ts")).first()
    assert (last["last"], last["high"], last["low"], last["mean_volume"]) == (106, 109, 95, 3000)


def snapshot(spark, bids, asks, n=1):
    prices = lambda side, k: [100.0 - i * 0.5 if side == "b" else 101.0 + i * 0.5 for i in range(k)]
    rows = [(1, i, prices("b", len(bids)), [float(x) for x in bids], prices("a", len(asks)), [float(x) for x in asks]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol long, seq long, bid_prices array<double>, bid_volumes array<double>, ask_prices array<double>, ask_volumes array<double>")


def test_depth_spread_and_mid(spark):
    r = book.depth(snapshot(spark, [10, 20, 30], [15, 25, 35])).first()
    m = book.map_book(snapshot(spark, [10, 20, 30], [15, 25, 35])).first()
    assert (r.bid_depth_5, r.ask_depth_5, r.total_depth) == (60, 75, 135)
    assert m.spread == 1.0 and (r.bid_prices[0] + r.ask_prices[0]) / 2 == 100.5


def test_imbalance_of_five_snapshots(spark):
    r = book.depth_analysis(snapshot(spark, [100, 50], [50, 25], 5)).agg(F.avg("depth_imbalance").alias("i")).first()
    assert round(r.i, 3) == 0.333


def test_map_book(spark):
    r = book.map_book(snapshot(spark, [100, 200, 150], [120, 180, 140])).first()
    assert (r.bid_depth, r.ask_depth, r.spread) == (450, 440, 1.0)


def tick_rows(spark, rows):
    return spark.createDataFrame([("x", T0 + dt.timedelta(seconds=i), i, float(p), q, s) for i, (p, q, s) in enumerate(rows)],
                                 "symbol string, ts timestamp, seq long, price double, quantity long, side string")


def test_vwap(spark):
    t = tick_rows(spark, [(100, 10, "buy"), (101, 20, "sell"), (102, 30, "buy"), (99, 40, "sell")])
    assert ag.trade_buffer(t, 4, 10).orderBy(F.desc("seq")).first().vwap == pytest.approx(100.4)


def test_bars_take_ties_by_sequence(spark):
    t = spark.createDataFrame([("x", T0, 2, 5.0, 1, "buy"), ("x", T0, 1, 9.0, 1, "sell")],
                              "symbol string, ts timestamp, seq long, price double, quantity long, side string")
    r = bars.time_bars(t, "1 minute").first()
    assert (r.open, r.close, r.buy_volume, r.sell_volume) == (9.0, 5.0, 1, 1)


def test_sides_and_sizes(spark):
    d = spark.createDataFrame([("COMPRA", 3), ("ask", 20), ("0", 50), ("V", 51), ("?", 1)], "s string, q int")
    got = d.select(fc.normal_side(F.col("s")).alias("s"), fc.size_class(F.col("q")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("buy", "small"), ("sell", "medium"), ("buy", "large"), ("sell", "whale"), (None, "small")]


def test_wilder_and_ema_prefixes(spark):
    b = series(spark, list(range(1, 8)))
    r = scan.smooth(b, ["symbol"], "ts", [("w", "close", "wilder", 3), ("e", "close", "ema", 3)]).orderBy("ts").collect()
    assert [x.w for x in r][:4] == [None, None, 2.0, pytest.approx(2 + 2 / 3)]
    assert [x.e for x in r][:3] == [1.0, 1.5, 2.25]


def test_quality_gate_of_rules(spark):
    t = tick_rows(spark, [(100, 1, "buy"), (-1, 1, "buy")])
    checked = quality.check(quality.prepared(t, ["seq"]), ["symbol"], quality.tick_rules())
    assert {r.rule for r in checked.where("NOT passed").collect()} == {"non_positive"}


def test_class_weights_and_labels(spark):
    d = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    assert {r.y: r.weight for r in dataset.class_weights(d, "y").collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    lab = dataset.bar_labels(series(spark, [100, 101, 100, 100]), 1, 0.005).orderBy("ts").collect()
    assert [r.target_class for r in lab] == [1, -1, 0]


def test_confusion_metrics(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "actual int, predicted int")
    r = evaluate.classification(d, [], [0, 1, 2]).first()
    assert r.accuracy == 0.5 and r.precision_1 == pytest.approx(1 / 3) and r.recall_0 == 0.5 and r.f1_2 == 0


def test_first_barrier(spark):
    rows = [("x", T0 + dt.timedelta(minutes=i), o, h, l, c, 1 if i == 0 else 0) for i, (o, h, l, c) in enumerate(
        [(100.0, 100.0, 100.0, 100.0), (100.0, 101.0, 99.5, 100.0), (100.0, 103.0, 99.0, 102.0), (102.0, 110.0, 90.0, 100.0)])]
    s = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, position int")
    got = {(r.stop, r.target): (r.reason, r.exit) for r in risk.outcomes(s, [(0.05, 0.02), (0.008, 0.5), (0.5, 0.5)], 0.0).collect()}
    assert got == {(0.05, 0.02): ("target", 102.0), (0.008, 0.5): ("stop", 99.2), (0.5, 0.5): ("session_end", 100.0)}


def test_excursions_equal_brute_force(spark):
    days = [("k", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i * 7 % 13), float(i * 5 % 11)) for i in range(40) if i % 6]
    bars_df = spark.createDataFrame(days, "symbol string, ts timestamp, high double, low double")
    trades = [("k", dt.datetime(2023, 12, 30) + dt.timedelta(days=a), dt.datetime(2023, 12, 30) + dt.timedelta(days=b)) for a in range(45) for b in range(a, 46, 3)]
    got = risk.excursions(spark.createDataFrame(trades, "regime string, entry_ts timestamp, exit_ts timestamp"), bars_df).collect()
    assert len(got) == len(trades)
    for r in got:
        inside = [d for d in days if r.entry_ts <= d[1] <= r.exit_ts]
        assert (r.high, r.low) == ((max(d[2] for d in inside), min(d[3] for d in inside)) if inside else (None, None))


def test_sample_is_repeatable(spark):
    d = spark.range(1000).withColumnRenamed("id", "seq")
    pick = lambda x: [r.seq for r in cleaning.sample_rows(x, "seq", 20).collect()]
    assert pick(d) == pick(d.repartition(7)) and len(set(pick(d))) == 20
