"""Operators that were made to hold at scale: no limits, no copies, no single groups."""

import datetime as dt

from pyspark.sql import functions as F


def test_alerts_by_stretches(spark):
    """Dense and sparse violations, tiny chunks: the same fires as one plain scan per key and rule."""
    import random

    from tickloom.operators.signals import AlertRule, alerts
    rnd, rows = random.Random(4), []
    for key in ("a", "b"):
        at = dt.datetime(2024, 1, 1)
        for _ in range(200):
            at += dt.timedelta(seconds=rnd.choice([1, 5, 30, 61, 500]))
            rows.append((key, at, rnd.random()))
    t = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    want = []
    for key in ("a", "b"):
        last = None
        for k, at, x in sorted(rows):
            if k == key and x > 0.4 and (last is None or (at - last).total_seconds() > 60):
                want.append((k, at))
                last = at
    got = alerts(t, [AlertRule("high", "x", F.col("x") > 0.4, "low")], 60, chunk_rows=7).collect()
    assert sorted((r.symbol, r.ts) for r in got) == sorted(want)


def test_alerts_of_one_unbroken_stretch(spark):
    """A rule broken at every row, hundreds of chunks; cooldowns below, at and far beyond a chunk's span; equal times at chunk edges; a null key."""
    from tickloom.operators.signals import AlertRule, alerts
    t0 = dt.datetime(2024, 1, 1)
    for cooldown in (3, 20, 95):
        rows = [("a", t0 + dt.timedelta(seconds=i * 2 - i % 3), float(i % 7)) for i in range(700)] + [(None, t0 + dt.timedelta(seconds=i // 4), 1.0) for i in range(90)]
        want = []
        for key in ("a", None):
            last = None
            for at, x in sorted((at, x) for k, at, x in rows if k == key):
                if last is None or (at - last).total_seconds() > cooldown:
                    want.append((key, at, x))
                    last = at
        got = alerts(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), [AlertRule("r", "x", F.col("x") >= 0, "low")], cooldown, chunk_rows=6)
        assert sorted(((r.symbol, r.ts, r.value) for r in got.collect()), key=str) == sorted(want, key=str)


def test_grid_and_retention(spark, tmp_path):
    """A grid beyond the old limit plans and counts; retention works below symbol and type folders; a merge prunes by date."""
    from tickloom.operators.history import grid
    from tickloom.sources import lake
    ends = spark.createDataFrame([("a", dt.datetime(1984, 1, 1)), ("a", dt.datetime(2024, 1, 1))], "symbol string, ts timestamp")
    assert grid(ends, 1).count() == 21_038_401
    ticks = spark.createDataFrame([("a", dt.datetime(2024, 1, d, 10), float(d), d) for d in range(1, 9)], "symbol string, ts timestamp, price double, seq long")
    lake.write_lake(ticks, f"{tmp_path}/lake", "trades")
    assert lake.drop_before(spark, f"{tmp_path}/lake", "2024-01-05") == [f"2024-01-0{d}" for d in range(1, 5)]
    assert spark.read.parquet(f"{tmp_path}/lake").count() == 4
    for _ in range(2):
        lake.merge_into(ticks, f"{tmp_path}/merged", ["symbol", "ts"], ["seq"])
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 8
    plan = lake.touched(spark, f"{tmp_path}/merged", [dt.date(2024, 1, 3)])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "2024-01-03" in plan.split("PartitionFilters", 1)[1][:200]


def test_time_sums_do_not_copy_rows(spark):
    """A window longer than the data, chunks of 64: marks and points are twice the rows."""
    from tickloom.operators.ordered import time_values
    t = spark.range(2000).select(F.lit("k").alias("symbol"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), (F.col("id") * 0.1).alias("v"))
    out = time_values(t, ["symbol"], "ts", {"s": ("sum", F.col("v"), 30 * 86400.0)}, chunk_rows=64).orderBy("ts").collect()
    assert abs(out[-1].s - sum(i * 0.1 for i in range(2000))) < 1e-6 and out[0].s == 0.0
    short = time_values(t, ["symbol"], "ts", {"s": ("sum", F.col("v"), 120.0)}, chunk_rows=64).orderBy("ts").collect()
    assert [round(r.s, 6) for r in short] == [round(sum(j * 0.1 for j in range(max(0, i - 2), i + 1)), 6) for i in range(2000)]


def test_fills_from_behind_read_each_row_once(spark):
    """No frame from a row to the end, which Spark reads anew for every row; a long gap, no value behind, a null key, one chunk or many."""
    from tickloom.operators.rolling import filled
    rows = [(k, i, None if i % 50 or i > 900 else float(i)) for k, n in (("a", 1000), (None, 40)) for i in range(n)]
    t = spark.createDataFrame(rows, "symbol string, seq long, x double").withColumn("ts", F.timestamp_seconds("seq"))
    for chunk in (32, 5000):
        out = filled(t, "x", 1, chunk)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        want = {(k, i): float(-(-i // 50) * 50) if -(-i // 50) * 50 <= min(n - 1, 900) else None for k, n in (("a", 1000), (None, 40)) for i in range(n)}
        assert {(r.symbol, r.seq): r.bfill for r in out.collect()} == want


def test_windows_of_one_value_share_its_running_total(spark):
    """Three windows of two values carry two totals and two counts through the order; the oldest time behind a mark, in chunks of 7."""
    import re

    from tickloom.operators import flow
    from tickloom.operators.ordered import time_values
    t = spark.range(300).select(F.when(F.col("id") % 3 == 0, "a").alias("symbol"), F.timestamp_seconds((F.col("id") / 4).cast("long") * 11).alias("ts"), F.col("id").alias("seq"),
                                F.when(F.col("id") % 5 > 0, F.col("id")).alias("quantity"), F.when(F.col("id") % 2 == 0, "buy").otherwise("sell").alias("side"))
    plan = flow.ofi_time(t, [20, 60, 200], 7)._jdf.queryExecution().toString()
    assert len(set(re.findall(r"_t_p_\w+(?=#)", plan))) == 2
    rows = t.collect()
    for r in time_values(t, ["symbol"], "ts", {"o": ("oldest", F.col("quantity"), 60)}, chunk_rows=7).collect():
        seen = [x.ts for x in rows if x.symbol == r.symbol and x.quantity is not None and 0 <= (r.ts - x.ts).total_seconds() <= 60]
        assert r.o == (min(seen) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 if seen else r.o is None


def test_replay_of_one_batch_is_many_files(spark):
    """A batch of 1000 rows in files of 100 rows about, still one batch, in order."""
    from tickloom.streaming import jobs
    t = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 2 == 1).alias("live"))
    batches = []
    jobs.drain_each(jobs.replay(t, 1, ["seq"], rows=100), lambda b, i: batches.append((b.count(), b.select(F.input_file_name()).distinct().count())))
    assert batches == [(1000, 10)]
    assert jobs.late_split(jobs.replay(t.withColumn("ts", F.timestamp_seconds(F.lit(5000) - F.col("seq"))), 4, ["seq"], rows=100), 400, ["seq"]).where("rejected = 1").count() == 300


def test_rolling_trades_fold_times_not_trades(spark, monkeypatch):
    """Trades of one time are one run of the folds and one row of the final look-up."""
    from tickloom.operators import risk
    seen, folds = [], risk.range_folds
    monkeypatch.setattr(risk, "range_folds", lambda o, w: (seen.append(o.rows.count()), folds(o, w))[1])
    t = spark.range(900).select(F.lit("r").alias("regime"), F.timestamp_seconds((F.col("id") % 9) * 600).alias("exit_ts"), F.col("id").alias("trade_id"), F.lit(1).alias("leg"),
                                F.lit(1.0).alias("quantity"), F.when(F.col("id") % 10 > 0, F.col("id") % 7 - 3.0).alias("pnl"))
    out = risk.rolling_trades(t, "regime", 1200, 5000).collect()
    assert seen == [9] and len(out) == 900 and max(r.n for r in out) == 300
