"""Scores of predictions, models and features, all as grouped aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import exact_quantiles, lay_out
from tickloom.operators.windows import corr, trend_slope
from tickloom.session import small_side


def _is(c: Column) -> Column:
    return c.cast("double")


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification(df: DataFrame, keys: list[str], classes: list[int], actual: str = "actual",
                   predicted: str = "predicted", confidence: str | None = None) -> DataFrame:
    """Accuracy, weighted precision/recall/F1, macro F1, per class, and confidence right/wrong."""
    a, p = F.col(actual), F.col(predicted)
    parts = [F.count(F.lit(1)).alias("n"), F.avg(_is(a == p)).alias("accuracy")]
    for c in classes:
        parts += [F.sum(_is((a == c) & (p == c))).alias(f"_tp{c}"), F.sum(_is(a == c)).alias(f"_s{c}"), F.sum(_is(p == c)).alias(f"_p{c}")]
    if confidence:
        parts += [F.avg(F.when(a == p, F.col(confidence))).alias("confidence_right"), F.avg(F.when(a != p, F.col(confidence))).alias("confidence_wrong")]
    g = df.groupBy(*keys).agg(*parts) if keys else df.agg(*parts)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    for c in classes:
        g = g.withColumns({f"precision_{c}": zero(F.try_divide(f"_tp{c}", f"_p{c}")), f"recall_{c}": zero(F.try_divide(f"_tp{c}", f"_s{c}"))})
        g = g.withColumn(f"f1_{c}", zero(F.try_divide(2 * F.col(f"precision_{c}") * F.col(f"recall_{c}"), F.col(f"precision_{c}") + F.col(f"recall_{c}"))))
    weighted = lambda m: sum((F.col(f"{m}_{c}") * F.col(f"_s{c}") for c in classes), F.lit(0.0)) / F.col("n")
    g = g.withColumns({"precision_weighted": weighted("precision"), "recall_weighted": weighted("recall"), "f1_weighted": weighted("f1"),
                       "f1_macro": sum((F.col(f"f1_{c}") for c in classes), F.lit(0.0)) / len(classes)})
    return g.drop(*[f"_{x}{c}" for x in ("tp", "s", "p") for c in classes])


def error_types(df: DataFrame, keys: list[str], sell: int = 0, buy: int = 2, limit: float = 0.8) -> DataFrame:
    a, p = F.col("actual"), F.col("predicted")
    return df.groupBy(*keys).agg(
        F.sum(_is(a != p)).alias("errors"), F.avg(_is(a != p)).alias("error_rate"),
        F.sum(_is((p == buy) & (a != buy))).alias("false_buys"), F.sum(_is((p == sell) & (a != sell))).alias("false_sells"),
        F.sum(_is((p != buy) & (a == buy))).alias("missed_buys"), F.sum(_is((p != sell) & (a == sell))).alias("missed_sells"),
        F.sum(_is((a != p) & (F.col("confidence") > limit))).alias("confident_errors"))


def trading_accuracy(df: DataFrame, keys: list[str], hold: int = 1) -> DataFrame:
    """Accuracy where the truth is not hold; precision, confidence and rate where the prediction is not."""
    a, p = F.col("actual"), F.col("predicted")
    return df.groupBy(*keys).agg(
        F.avg(F.when(a != hold, _is(a == p))).alias("trading_accuracy"), F.avg(F.when(p != hold, _is(a == p))).alias("trade_precision"),
        F.avg(F.when(p != hold, F.col("confidence"))).alias("trade_confidence"), F.avg(_is(p != hold)).alias("trade_rate"))


def rolling_accuracy(preds: DataFrame, n: int, minimum: int, chunk_rows: int | None = None) -> DataFrame:
    """Accuracy of the last n predictions and the slope of that accuracy."""
    o = lay_out(preds, ["symbol"], ["ts", "seq"], chunk_rows)
    f = o.last(n)
    hit = _is(F.col("predicted") == F.col("actual"))
    rows = o.chunked(before=2 * n).withColumn("accuracy", F.when(F.count(hit).over(f) >= minimum, F.avg(hit).over(f)))
    return o.finish(rows.withColumn("trend", trend_slope(F.col("accuracy"), F.col("_rn"), f, n)), "symbol", "seq", "accuracy", "trend")


def diversity(df: DataFrame, models: list[str], actual: str = "actual") -> DataFrame:
    """Disagreement, correlation, Q statistic and Cohen's kappa of each pair of prediction columns."""
    pairs = list(combinations(models, 2))
    parts = []
    for i, (m1, m2) in enumerate(pairs):
        x, y, t = F.col(m1), F.col(m2), F.col(actual)
        parts += [F.avg(_is(x != y)).alias(f"d{i}"), corr(F.col(m1), F.col(m2)).alias(f"c{i}"),
                  F.sum(_is((x == t) & (y == t))).alias(f"a{i}"), F.sum(_is((x != t) & (y != t))).alias(f"b{i}"),
                  F.sum(_is((x == t) & (y != t))).alias(f"e{i}"), F.sum(_is((x != t) & (y == t))).alias(f"f{i}"),
                  (F.avg(_is(x == 1)) * F.avg(_is(y == 1)) + F.avg(_is(x == 0)) * F.avg(_is(y == 0))).alias(f"p{i}")]
    wide = df.agg(*parts)
    col = lambda s, i: F.col(f"{s}{i}")
    rows = F.array(*[F.struct(
        F.lit(m1).alias("model1"), F.lit(m2).alias("model2"), col("d", i).alias("disagreement"), col("c", i).alias("correlation"),
        F.coalesce(F.try_divide(col("a", i) * col("b", i) - col("e", i) * col("f", i), col("a", i) * col("b", i) + col("e", i) * col("f", i)), F.lit(0.0)).alias("q"),
        F.try_divide(1 - col("d", i) - col("p", i), 1 - col("p", i)).alias("kappa")) for i, (m1, m2) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def ensemble(df: DataFrame, models: list[str], actual: str = "actual") -> DataFrame:
    """Accuracy-weighted vote of 0/1 models, simple vote, and whether any model was right, per row."""
    fitted = df.agg(*[F.avg(_is(F.col(m) == F.col(actual))).alias(f"_w{i}") for i, m in enumerate(models)])
    total = sum((F.col(f"_w{i}") for i in range(len(models))), F.lit(0.0))
    vote = sum((F.col(m) * F.col(f"_w{i}") for i, m in enumerate(models)), F.lit(0.0)) / total
    plain = sum((F.col(m) for m in models), F.lit(0)) / len(models)
    oracle = sum(((F.col(m) == F.col(actual)).cast("int") for m in models), F.lit(0)) > 0
    return df.crossJoin(F.broadcast(fitted)).withColumns({
        "weighted": (vote > 0.5).cast("int"), "majority": (plain > 0.5).cast("int"), "any_right": oracle.cast("int")}).drop(
        *[f"_w{i}" for i in range(len(models))])


def weight_grid(df: DataFrame, m1: str, m2: str, steps: int, actual: str = "actual") -> DataFrame:
    """Accuracy of every mixture of two models on a grid of weights, in one aggregation."""
    ws = [i / steps for i in range(steps + 1)]
    wide = df.agg(*[F.avg(_is((F.col(m1) * w + F.col(m2) * (1 - w) > 0.5).cast("int") == F.col(actual))).alias(f"w{i}") for i, w in enumerate(ws)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"w{i}").alias("accuracy")) for i, w in enumerate(ws)])).alias("r")).select("r.*")


def regression(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("_v"))
    return g.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide("mse", "_v")}).drop("_v")


def drift(preds: DataFrame, recent: int, chunk_rows: int | None = None) -> DataFrame:
    """Recent against earlier rows of a key: prediction mean, accuracy, confidence and volatility shifts."""
    o = lay_out(preds, ["symbol"], ["ts", "seq"], chunk_rows)
    rows = o.with_size().withColumn("_new", F.col("_rn") > F.col("_n") - recent)
    hit, p, c = _is(F.col("predicted") == F.col("actual")), F.col("predicted"), F.col("confidence")
    part = lambda f, x, new: f(F.when(F.col("_new") == new, x))
    g = rows.groupBy("symbol").agg(
        (part(F.avg, p, True) - part(F.avg, p, False)).alias("mean_shift"),
        (part(F.avg, hit, False) - part(F.avg, hit, True)).alias("accuracy_drop"),
        (part(F.avg, c, False) - part(F.avg, c, True)).alias("confidence_drop"),
        F.abs(part(F.stddev_samp, c, True) / part(F.stddev_samp, c, False) - 1).alias("volatility_change"))
    return g.withColumn("degraded", ((F.col("accuracy_drop") > 0.1) | (F.col("confidence_drop") > 0.1)
                                     | (F.col("volatility_change") > 0.2)).cast("int"))


def agreement(df: DataFrame, votes: list[str], features: list[str], limit: float) -> DataFrame:
    """Ensemble agreement (one less the deviation), share of usable features, anomaly flag."""
    arr = F.array(*[F.col(v).cast("double") for v in votes])
    k = len(votes)
    mean = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / k
    std = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / k)
    good = sum(((F.col(c).isNotNull() & (F.col(c) != 0)).cast("int") for c in features), F.lit(0)) / float(len(features))
    out = df.withColumns({"agreement": 1 - F.least(std, F.lit(1.0)), "feature_quality": good})
    return out.withColumn("anomaly", ((F.col("agreement") < limit) | (F.col("feature_quality") < 0.5)).cast("int"))


def retrain_due(preds: DataFrame, hours: float, rows: int, last_n: int, minimum: float, since: str, chunk_rows: int | None = None) -> DataFrame:
    """Elapsed time and new rows since the last training, win share of the last n, and the verdict."""
    o = lay_out(preds, ["symbol"], ["ts", "seq"], chunk_rows)
    hit = _is(F.col("predicted") == F.col("actual"))
    cut = F.lit(since).cast("timestamp")
    g = o.with_size().groupBy("symbol").agg(
        ((F.unix_seconds(F.max("ts")) - F.unix_seconds(cut)) / 3600.0).alias("hours"),
        F.sum((F.col("ts") > cut).cast("int")).alias("new_rows"),
        F.avg(F.when(F.col("_rn") > F.col("_n") - last_n, hit)).alias("win_rate"))
    return g.withColumn("retrain", (((F.col("hours") >= hours) & (F.col("new_rows") >= rows)) | (F.col("win_rate") < minimum)).cast("int"))


def feature_scores(df: DataFrame, cols: list[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information (binned), ANOVA F and chi-square of each column against the label.

    One pass of exact bin edges for all columns, then one grouped count over (column, bin, label).
    """
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("y", "r.feature", "r.x")
    edges = [f"_e{i}" for i in range(1, bins)]
    q = exact_quantiles(long, ["feature"], "x", {e: (i + 1) / bins for i, e in enumerate(edges)})
    long = long.join(small_side(q), "feature").withColumn(
        "bin", sum(((F.col("x") > F.col(e)).cast("int") for e in edges), F.lit(0))).drop(*edges)
    cell = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    wb, wy, wf = Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "y"), Window.partitionBy("feature")
    c = cell.withColumns({"nb": F.sum("n").over(wb), "ny": F.sum("n").over(wy), "t": F.sum("n").over(wf)})
    n, nb, ny, t = (F.col(x).cast("double") for x in ("n", "nb", "ny", "t"))
    # chi-square over all cells, absent ones included: sum n^2/e over present cells, less the total
    tests = c.groupBy("feature").agg(
        F.sum(n / t * F.log(n * t / (nb * ny))).alias("mutual_information"), (F.sum(n * n * t / (nb * ny)) - F.max(t)).alias("chi_square"))
    group = cell.groupBy("feature", "y").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"))
    f = group.groupBy("feature").agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.sum("sx").alias("s"), F.sum("sxx").alias("ss"),
        F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("between"))
    anova = f.select("feature", (((F.col("between") - F.col("s") * F.col("s") / F.col("t")) / (F.col("k") - 1))
                                 / ((F.col("ss") - F.col("between")) / (F.col("t") - F.col("k")))).alias("f_score"))
    return tests.join(anova, "feature")


def combined_ranking(scores: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Scores scaled by their maxima, weighted, top k (one row per feature, so the table is small)."""
    tops = scores.agg(*[F.max(c).alias(f"_{c}") for c in weights])
    total = sum((F.coalesce(F.try_divide(c, f"_{c}"), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return scores.crossJoin(F.broadcast(tops)).select("feature", total.alias("score")).orderBy(F.desc("score"), "feature").limit(k)


def attach_small(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(small_side(table), key)
