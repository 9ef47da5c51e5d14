"""Filters, scaling and column cleaning over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import exact_quantiles
from tickloom.session import small_side


def sample_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a hash of the key: the same sample on every run and cluster."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns})


def split_valid(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the first broken rule, null when the row is valid."""
    checks = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("reason", F.coalesce(*checks))


def robust_z(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(x - median) / (1.4826 * MAD) per key, both medians exact."""
    med = exact_quantiles(df, keys, col, {"_med": 0.5})
    dev = df.join(small_side(med), keys).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = exact_quantiles(dev, keys, "_dev", {"_mad": 0.5})
    z = F.coalesce(F.try_divide(F.col(col) - F.col("_med"), 1.4826 * F.col("_mad")), F.lit(0.0))
    return dev.join(small_side(mad), keys).withColumn("z", z).drop("_dev")


def scaled(df: DataFrame, key: str, price: str, quantity: str) -> DataFrame:
    """Price scaled to 0..1 per key and quantity as z-score over the whole table."""
    per = small_side(df.groupBy(key).agg(F.min(price).alias("_lo"), F.max(price).alias("_hi")))
    whole = df.agg(F.avg(quantity).alias("_m"), F.stddev_samp(quantity).alias("_s"))
    return df.join(per, key).crossJoin(F.broadcast(whole)).withColumn(
        "price_scaled", F.coalesce(F.try_divide(F.col(price) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    ).withColumn("quantity_z", (F.col(quantity) - F.col("_m")) / (F.col("_s") + 1e-8))


def quantile_flags(df: DataFrame, keys: list[str], col: str, probs: list[float]) -> DataFrame:
    """1 where the value lies above its key's quantile."""
    names = {f"_q{round(p * 100)}": p for p in probs}
    q = exact_quantiles(df, keys, col, names)
    out = df.join(small_side(q), keys)
    return out.withColumns({
        f"{col}_above_p{n[2:]}": (F.col(col) > F.col(n)).cast("int") for n in names}).drop(*names)


def usable_columns(df: DataFrame, cols: list[str], max_null: float = 0.5) -> DataFrame:
    """One row per column with null share and variance, and whether to keep it."""
    n = F.count(F.lit(1))
    parts = []
    for c in cols:
        parts += [((n - F.count(c)) / n).alias(f"{c}_nulls"), F.var_samp(c).alias(f"{c}_var")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_nulls").alias("null_share"),
                              F.col(f"{c}_var").alias("variance")) for c in cols])
    return df.agg(*parts).select(F.explode(rows).alias("r")).select(
        "r.*", ((F.col("r.null_share") <= max_null) & (F.coalesce("r.variance", F.lit(0.0)) > 0))
        .cast("int").alias("keep"))


def drop_unusable(df: DataFrame, cols: list[str], max_null: float = 0.5) -> DataFrame:
    """Drop the columns that ``usable_columns`` rejects (a driver-side list of column names)."""
    bad = [r.feature for r in usable_columns(df, cols, max_null).where("keep = 0").collect()]
    return df.drop(*bad)


def required(df: DataFrame, names: list[str], prefix: str = "") -> list[Column]:
    """The named columns, zero where null or absent, optionally prefixed."""
    return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(prefix + c)
            for c in names]


def any_of(*rules: Column) -> Column:
    return reduce(lambda a, b: a | b, rules)
