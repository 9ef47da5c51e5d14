"""Registered queries: a Spark builder and, where SQL can say it, the same result in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans import views

Builder = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(fn: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"duplicate query {name}")
        BUILDERS[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def with_views(body: str) -> str:
    """Prefix the CTEs of the adapter views that ``body`` (or a used view) names."""
    used: list[str] = []

    def visit(text: str) -> None:
        for v in views.SQL:
            if v not in used and re.search(rf"\b{v}\b", text):
                visit(views.SQL[v])
                if v not in used:
                    used.append(v)
    visit(body)
    body = body.strip()
    if not used:
        return body
    ctes = ",\n".join(f"{v} AS ({views.SQL[v].strip()})" for v in used)
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def rd(c: Column | str, n: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), n) + F.lit(0.0)


def rsql(expr: str, n: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {n}) + 0::DOUBLE)"
