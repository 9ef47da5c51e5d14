"""Places where a user's own function runs inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from tickloom.operators.ordered import Ordered


def per_chunk(o: Ordered, fn: Callable[[pd.DataFrame], pd.Series], name: str, kind: T.DataType, look_back: int, keep: list[str]) -> DataFrame:
    """A vectorised feature of a key's ordered rows.

    ``fn`` gets the rows of one chunk in order, preceded by ``look_back`` rows of the chunk before;
    the overlap is trimmed, so chunk edges neither repeat nor lose rows.
    """
    rows = o.chunked(before=look_back)
    schema = T.StructType([f for f in rows.schema.fields if f.name in keep] + [T.StructField(name, kind)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        pdf[name] = fn(pdf)
        return pdf.loc[pdf["_own"], [*keep, name]]

    return rows.groupBy("_key", "_chunk").applyInPandas(run, schema)


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """A user's function over whole groups; only for keys whose groups are small by construction."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def where_all(df: DataFrame, predicates: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """User predicates as columns of a frame, combined by AND."""
    for p in predicates.values():
        df = df.where(p(df))
    return df
