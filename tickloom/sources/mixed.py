"""CSV files of one folder whose headers, column orders and separators differ."""

from __future__ import annotations

import csv
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.sources.lake import between

# Header names of a file's time column, any case.
TIMES = ("date", "timestamp", "datetime", "time")
#: Longest header line, in bytes; only this much of a file is looked at before it is read in tasks.
HEADER = 65_536
#: Ways to write a time, besides the ISO forms.
FORMATS = ("yyyyMMdd", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss")


def read_csv(spark: SparkSession, paths: list[str], fields: T.StructType, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """``fields`` from every file below ``paths``, by the names in its own header; half-open time filter.

    The first of ``TIMES`` (or else ``ts`` itself) in a file's header is its time column, other names may be known aliases.
    Files of one layout are read together by Spark's own reader, split into byte ranges, with only the columns that are
    wanted.  A wanted column that a file lacks is null.  Files without a time column or any line give no rows (a
    warning names their number); values and times that cannot be read are null, and rows with a null time fail a filter.
    Before that, the first line of each file is looked at: one small read per file, as its listing is.
    """
    layouts: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    skipped = 0
    for path, line in first_lines(spark, paths):
        sep, names = layout(line)
        if time_column(names, ts) is None:
            skipped += 1
        else:
            layouts.setdefault((sep, names), []).append(path)
    if skipped:
        logging.getLogger(__name__).warning("%d files have no time column", skipped)
    parts = [_read(spark, files, sep, names, fields, ts) for (sep, names), files in sorted(layouts.items())]
    if not parts:
        return spark.createDataFrame([], fields)
    return between(reduce(DataFrame.unionByName, parts), ts, start, end)


def layout(line: str) -> tuple[str, tuple[str, ...]]:
    """Separator (the most frequent of four) and column names of a header line."""
    line = line.removeprefix("\ufeff").rstrip("\r\n")
    sep = max(",;\t|", key=line.count)
    return sep, tuple(n.strip() for n in next(csv.reader([line], delimiter=sep), []))


def time_column(names: tuple[str, ...], ts: str = "ts") -> int | None:
    """Place of the first time column, or of ``ts`` where there is none."""
    low = [n.lower() for n in names]
    return next((i for i, n in enumerate(low) if n in TIMES), low.index(ts) if ts in low else next((i for i, n in enumerate(low) if schema.ALIASES.get(n) == ts), None))


def _read(spark: SparkSession, files: list[str], sep: str, names: tuple[str, ...], fields: T.StructType, ts: str) -> DataFrame:
    at, place = time_column(names, ts), {}
    for i, n in enumerate(names):  # a name that comes twice: its first column counts
        place.setdefault(schema.ALIASES.get(n.lower(), n.lower()), i)
    place[ts] = at
    raw = spark.read.csv(files, sep=sep, header=True, schema=T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))]))
    return raw.select(*[_value(F.col(f"_{place[f.name]}") if f.name in place else F.lit(None), f, ts).alias(f.name) for f in fields])


def _value(x: Column, field: T.StructField, ts: str) -> Column:
    if field.name != ts:
        return x.try_cast(field.dataType)
    text = F.trim(x.cast("string"))
    compact = text.rlike("^[0-9]{8}$")
    return F.coalesce(F.when(~compact, text.try_cast("timestamp")), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]).cast(field.dataType)


def first_lines(spark: SparkSession, paths: list[str]):
    """(file, first line) of every visible file below ``paths``; compressed ones are read through their codec."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    for root in paths:
        top = hadoop.fs.Path(root)
        fs = top.getFileSystem(conf)
        found = fs.listFiles(top, True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName()[0] in "._":
                continue
            codec = codecs.getCodec(path)
            stream = fs.open(path) if codec is None else codec.createInputStream(fs.open(path))
            try:
                head = bytes(stream.readNBytes(HEADER))
            finally:
                stream.close()
            yield path.toString(), head.split(b"\n", 1)[0].decode("utf-8", "replace")
