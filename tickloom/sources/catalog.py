"""Catalog of datasets as append-only tables whose latest row per key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import dedupe

KEYS = ["symbol", "data_type", "date"]


def entries(df: DataFrame, data_type: str, version: int, bytes_per_row: int) -> DataFrame:
    """One catalog row per symbol and day of ``df``."""
    return df.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("quantity").alias("volume")).select(
        "symbol", F.lit(data_type).alias("data_type"), "date", "records", (F.col("records") * bytes_per_row).alias("size_bytes"),
        F.lit(version).alias("version"), "volume")


def register(new: DataFrame, root: str) -> None:
    new.write.mode("append").parquet(root)


def current(log: DataFrame) -> DataFrame:
    return dedupe.keep(log, KEYS, ["version"], last=True)


def available_dates(log: DataFrame, symbol: str, data_type: str) -> DataFrame:
    return current(log).where((F.col("symbol") == symbol) & (F.col("data_type") == data_type)).select("date").distinct().orderBy("date")


def stats(log: DataFrame, quality: DataFrame) -> DataFrame:
    """Totals per symbol and type, with the mean quality of the days that have one."""
    return current(log).join(quality, ["symbol", "date"], "left").groupBy("symbol", "data_type").agg(
        F.count(F.lit(1)).alias("days"), F.sum("records").alias("records"), F.sum("size_bytes").alias("size_bytes"),
        F.min("date").alias("first"), F.max("date").alias("last"), F.avg("score").alias("quality"))


def large_old(log: DataFrame, before: str, minimum: int) -> DataFrame:
    return current(log).where((F.col("date") < F.lit(before).cast("date")) & (F.col("size_bytes") > minimum)).orderBy(F.desc("size_bytes"), "symbol", "date")
