"""CSV files with differing headers in one folder."""

import datetime as dt
import gzip

from tickloom import schema
from tickloom.sources import mixed

FIELDS = schema._struct(symbol="s", ts="t", seq="l", price="d", quantity="l")


def test_layouts_of_one_folder(spark, tmp_path):
    """Order, names, case, separators, time forms, BOM, quotes, gzip, a missing column, a name twice, no time column, an empty file."""
    (tmp_path / "deep").mkdir()
    files = {
        "a.csv": "Date,symbol,seq,price,quantity\n2024-01-05 10:00:00,x,1,10.5,3\n2024-01-06T10:00:00.250000,x,2,10.5,\n",
        "b.csv": "\ufeffqtd;preco;ticker;DATETIME;seq\n4;11.5;\"y;z\";05/01/2024 11:00:00;3\n",
        "deep/c.csv": "seq,price,time,price,date\n4,12.5,20240107,99,2030-01-01\n5,oops,never,1,\n",
        "d.csv": "symbol,price\nlost,1\n", "e.csv": "", "_hidden.csv": "Date,seq\n2024-01-01,9\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "f.csv.gz").write_bytes(gzip.compress(b"timestamp|seq|symbol\n2024-01-08|6|g\n"))
    got = sorted((tuple(r) for r in mixed.read_csv(spark, [str(tmp_path)], FIELDS).collect()), key=lambda r: r[2])
    assert got == [("x", dt.datetime(2024, 1, 5, 10), 1, 10.5, 3), ("x", dt.datetime(2024, 1, 6, 10, 0, 0, 250000), 2, 10.5, None),
                   ("y;z", dt.datetime(2024, 1, 5, 11), 3, 11.5, 4), (None, dt.datetime(2024, 1, 7), 4, 12.5, None), (None, None, 5, None, None),
                   ("g", dt.datetime(2024, 1, 8), 6, None, None)]
    cut = mixed.read_csv(spark, [str(tmp_path)], FIELDS, "2024-01-06", "2024-01-08")
    assert sorted(r.seq for r in cut.collect()) == [2, 4]


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert mixed.read_csv(spark, [str(tmp_path)], FIELDS).collect() == [] and mixed.read_csv(spark, [str(tmp_path)], FIELDS).schema == FIELDS


def test_only_wanted_columns_are_parsed(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,date,seq,b,c\n1,2024-01-01,7,3,4\n")
    df = mixed.read_csv(spark, [str(tmp_path)], FIELDS).select("seq")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "ReadSchema: struct<_2:string>" in plan and df.collect()[0].seq == 7
