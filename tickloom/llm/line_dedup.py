"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of a line, exact counts near the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import body, hot_join
from tickloom.session import pin

#: Sites from which on a line is boilerplate; precision of the sketches; relative distance below which sites are counted exactly.
LEAST_SITES, SKETCH_BITS, NEAR = 8, 12, 0.15
#: Boilerplate lines that the plan may hold as a set of hashes; with more of them, places of lines and rows meet by joins.
IN_PLAN = 10_000


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that is not blank: the row's key, the site, the line's place and hash. Lines end at a line feed."""
    return (docs.select(_key().alias("k"), F.col(site).cast("string").alias("site"), F.posexplode(F.split(body(), "\n")).alias("i", "line"))
            .filter(F.trim("line") != "").select("k", "site", "i", F.struct(F.xxhash64("line").alias("h"), F.length("line").alias("n")).alias("line")))


def _key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63)).alias("a"), F.xxhash64(body()).alias("b"))


def boilerplate(docs: DataFrame, site: str = "source", least: int = LEAST_SITES) -> DataFrame:
    """Lines found on ``least`` sites or more: ``line`` (its hash and length) and ``rows``, the number of its places.

    Places are counted first: a line with fewer of them than ``least`` needs no sketch. Sketches of
    sites are merged by aggregation, per task and then per line. Lines whose estimate
    is within ``NEAR`` of the limit are decided by exact distinct counts. A null site is no site.
    """
    lines = _lines(docs, site)
    often = pin(lines.groupBy("line").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least))
    sketched = pin(hot_join(lines, often, "line", "rows").groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.count(F.lit(1)).alias("rows")).filter(F.col("sites") >= least * (1 - NEAR)))
    near = sketched.filter(F.col("sites") <= least * (1 + NEAR))
    pairs = pin(hot_join(lines, near.select("line", "rows"), "line", "rows").groupBy("line", "site").agg(F.count(F.lit(1)).alias("n")))
    exact = pairs.groupBy("line").agg(F.count("site").alias("sites"), F.sum("n").alias("rows")).filter(F.col("sites") >= least)
    return pin(sketched.filter(F.col("sites") > least * (1 + NEAR)).select("line", "rows").unionByName(exact.select("line", "rows")))


def remove_boilerplate(docs: DataFrame, site: str = "source", least: int = LEAST_SITES) -> DataFrame:
    """All rows and columns of ``docs`` with cleaned ``text``, and ``n_lines`` and ``n_removed`` in a struct ``lines``.

    Blank lines are kept and never removed. Null text is empty: one blank line. Rows with equal id
    and text are cleaned alike; a null id is as good as another. A very long text is cleaned whole, in
    its row. No rows in, none out. Other columns may have any name but ``lines``, which is replaced.
    """
    found = boilerplate(docs, site, least)
    split, rows = F.split("text", "\n"), docs.select(F.struct("*").alias("row"), body().alias("text"), _key().alias("k"))
    if found.count() <= IN_PLAN:  # a checked bound: every row is cleaned where it is
        gone = [r.h for r in found.select("line.h").collect()]
        clean = F.filter(split, lambda line: (F.trim(line) == "") | ~F.xxhash64(line).isin(gone)) if gone else split
        done = rows.withColumn("kept", clean).select("row", F.array_join("kept", "\n").alias("text"), F.size(split).alias("n"), (F.size(split) - F.size("kept")).alias("m"))
    else:
        hits = hot_join(_lines(docs, site), found, "line", "rows").select("k", "i")
        rows = rows.join(hits.groupBy("k").agg(F.collect_set("i").alias("gone")), "k", "left")
        clean = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i)), "\n")
        done = rows.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(clean).alias("text"), F.size(split).alias("n"), F.coalesce(F.size("gone"), F.lit(0)).alias("m"))
    done = done.select("row", "text", F.struct(F.col("n").cast("long").alias("n_lines"), F.col("m").cast("long").alias("n_removed")).alias("lines"))
    names = [c for c in docs.columns if c != "lines"]
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], "lines")
