"""Published versions: readers see whole ones only, whatever is lost in between."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.sources import lake, published as pb


def days(spark, days_, mark, rows=3):
    data = [("a", dt.datetime(2024, 1, d, 10, i), mark + i, d * 10 + i) for d in days_ for i in range(rows)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, price double, seq long").withColumn("date", F.to_date("ts"))


def content(df):
    return sorted(tuple(r) for r in df.select("ts", "price").collect())


def test_a_writer_lost_before_the_last_step_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    assert pb.merge(days(spark, [1, 2, 3], 1.0), root, "date", ["symbol", "ts"], ["seq", "price"]) == 1
    before = content(pb.read(spark, root))
    with monkeypatch.context() as m:
        m.setattr(pb, "_announce", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            pb.merge(days(spark, [2, 4], 9.0), root, "date", ["symbol", "ts"], ["seq", "price"])
    assert content(pb.read(spark, root)) == before
    pb.merge(days(spark, [2, 4], 9.0), root, "date", ["symbol", "ts"], ["seq", "price"])
    after = content(pb.read(spark, root))
    assert len(after) == 12 and {p for t, p in after if t.day == 2} == {9.0, 10.0, 11.0} and {p for t, p in after if t.day == 1} == {1.0, 2.0, 3.0}
    assert content(pb.read(spark, root, version=1)) == before
    assert content(pb.read(spark, root, parts=["date=2024-01-04"])) == [r for r in after if r[0].day == 4]


def test_vacuum_keeps_live_folders(spark, tmp_path):
    root = str(tmp_path / "t")
    for mark in (1.0, 2.0, 3.0):
        pb.publish(days(spark, [1, 2], mark), root, "date")
    pb.publish(days(spark, [2], 4.0), root, "date")
    want = content(pb.read(spark, root))
    assert pb.vacuum(spark, root) == [] and pb.versions(spark, root) == [1, 2, 3, 4]
    gone = pb.vacuum(spark, root, keep=1, grace=0)
    assert len(gone) == 5 and pb.versions(spark, root) == [4] and content(pb.read(spark, root)) == want


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    pb.publish(days(spark, [1], 1.0), root, "date", tag=7)
    old = pb.manifest(spark, root)
    pb.publish(days(spark, [1], 2.0), root, "date", tag=8)
    with monkeypatch.context() as m:
        m.setattr(pb, "manifest", lambda *a: old)
        with pytest.raises(pb.Conflict):
            pb.publish(days(spark, [1], 3.0), root, "date")
    assert {p for _, p in content(pb.read(spark, root))} == {2.0, 3.0, 4.0} and pb.last_tag(spark, root) == 8


def test_empty_and_null_partitions(spark, tmp_path):
    root, whole = str(tmp_path / "t"), str(tmp_path / "w")
    assert pb.last_tag(spark, root) is None
    with pytest.raises(FileNotFoundError):
        pb.read(spark, root)
    pb.publish(days(spark, [1], 1.0).limit(0), root, "date")
    assert pb.read(spark, root).count() == 0
    for _ in range(2):
        pb.merge(days(spark, [1, 2], 1.0).withColumn("date", F.when(F.col("ts") < "2024-01-02", F.col("date"))), root, "date", ["symbol", "ts"], ["seq"])
    assert pb.read(spark, root).count() == 6 and pb.read(spark, root).where("date IS NULL").count() == 3
    pb.publish(days(spark, [1], 1.0), whole)
    pb.publish(days(spark, [2], 1.0), whole)
    assert {t.day for t, _ in content(pb.read(spark, whole))} == {2}


def test_lake_merge_survives_a_loss_between_its_steps(spark, tmp_path, monkeypatch):
    """The day's old folder is moved aside first; the next merge puts it back if its successor never came."""
    root = str(tmp_path / "l")
    t = days(spark, [1, 2], 1.0).drop("date")
    lake.merge_into(t, root, ["symbol", "ts"], ["seq"])
    with monkeypatch.context() as m:
        m.setattr(lake, "_swap_in", lambda *a: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            lake.merge_into(days(spark, [2], 5.0).drop("date"), root, ["symbol", "ts"], ["seq"])
    lake.merge_into(days(spark, [3], 5.0).drop("date"), root, ["symbol", "ts"], ["seq"])
    assert spark.read.parquet(root).groupBy("date").count().count() == 3 and spark.read.parquet(root).count() == 9


def test_streams_go_on_after_a_restart_and_drop_old_versions(spark, tmp_path):
    """Two runs over one checkpoint; a batch that is repeated after it was published changes nothing."""
    import os

    from tests.data import ticks
    from tickloom.streaming import jobs
    t = spark.createDataFrame(ticks(200)).repartition(1)
    inbox = str(tmp_path / "in")
    ring, candles, state = ([str(tmp_path / f"{n}-{x}") for x in ("out", "log")] for n in ("ring", "candles", "state"))
    for part in ("seq < 80", "seq >= 80"):
        t.where(part).coalesce(1).write.mode("append").parquet(inbox)
        s = lambda: jobs.source(spark, inbox, t.schema, 1)
        last = jobs.ring_buffer(s(), 10, *ring, grace=0)
        bars = jobs.all_candles(s(), "10 minutes", out=candles[0], log=candles[1], grace=0)
        sums = jobs.running_state(s(), *state, grace=0)
    rows = ticks(200)
    for key in ("hot", "a", "b"):
        want = rows[rows.symbol == key].sort_values(["ts", "seq"]).seq.tolist()[-10:]
        assert sorted(r.seq for r in last.where(F.col("symbol") == key).collect()) == sorted(want)
    assert {r.symbol: r.trades for r in sums.collect()} == rows.groupby("symbol").size().to_dict()
    assert bars.agg(F.sum("trades")).first()[0] == 200 and bars.count() == bars.select("symbol", "ts").distinct().count()
    for out in (ring[0], candles[0], state[0]):
        assert len(os.listdir(f"{out}/manifests")) <= 2 * 2  # with checksum files
    number = pb.versions(spark, ring[0])[-1]
    jobs._keep(t.limit(5), 0, ring[0], lambda: t.limit(5), 0)
    assert pb.versions(spark, ring[0])[-1] == number
