"""Labels, folds, scaling, learning and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import dataset as ds, evaluate as ev, learn, rolling as ro
from tickloom.operators.windows import by_time, pct_change, rmean, rstd
from tickloom.plans import views as v
from tickloom.plans.q_book import RAW_TOPS, tops
from tickloom.plans.registry import query, rd, rsql as r
from tickloom.plans.winsql import flag, fr, lag, mean, std

TP = "PARTITION BY symbol ORDER BY ts, seq"
K = "PARTITION BY k ORDER BY ts"
FUT = f"f0 AS (SELECT *, lead(price, 20) OVER ({TP}) / price - 1 AS ret FROM ticks), f AS (SELECT * FROM f0 WHERE ret IS NOT NULL)"


@query("m01_m06_bar_labels", f"""
WITH a AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS x FROM bars)
SELECT symbol, ts, {r("x")} AS target_return, {flag("x > 0")} AS target_binary, CASE WHEN x > 0.002 THEN 1 WHEN x < -0.002 THEN -1 ELSE 0 END AS target_class, {r("abs(x)")} AS target_magnitude FROM a WHERE x IS NOT NULL""")
def _(spark, sf):
    return ds.bar_labels(v.bars(spark, sf), 5, 0.002).select("symbol", "ts", "target_binary", "target_class", rd("target_return").alias("target_return"), rd("target_magnitude").alias("target_magnitude"))


@query("m02_quantile_label", f"""
WITH {FUT}, q AS (SELECT symbol AS s, quantile_cont(ret, 0.3) AS lo, quantile_cont(ret, 0.7) AS hi FROM f GROUP BY 1)
SELECT symbol, seq, CASE WHEN ret > hi THEN 1 WHEN ret < lo THEN -1 ELSE 0 END AS target FROM f JOIN q ON symbol = s""")
def _(spark, sf):
    x = ds.future_returns(v.ticks(spark, sf), 20)
    return ds.label(x, ds.fit_quantiles(x, "ret", 0.3, 0.7), "ret").select("symbol", "seq", "target")


@query("m02_quantile_label_fit_on_train", f"""
WITH {FUT}, q AS (SELECT symbol AS s, quantile_cont(ret, 0.2) AS lo, quantile_cont(ret, 0.8) AS hi FROM f WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT symbol, seq, CASE WHEN ret > hi THEN 1 WHEN ret < lo THEN -1 ELSE 0 END AS target FROM f JOIN q ON symbol = s""")
def _(spark, sf):
    x = ds.future_returns(v.ticks(spark, sf), 20)
    fitted = ds.fit_quantiles(x.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), "ret", 0.2, 0.8)
    return ds.label(x, fitted, "ret").select("symbol", "seq", "target")


@query("m03_sigma_label", f"""
WITH {FUT}, q AS (SELECT symbol AS s, avg(ret) - 0.5 * stddev_samp(ret) AS lo, avg(ret) + 0.5 * stddev_samp(ret) AS hi FROM f GROUP BY 1)
SELECT symbol, seq, CASE WHEN ret > hi THEN 1 WHEN ret < lo THEN -1 ELSE 0 END AS target FROM f JOIN q ON symbol = s""")
def _(spark, sf):
    x = ds.future_returns(v.ticks(spark, sf), 20)
    return ds.label(x, ds.fit_sigma(x, "ret", 0.5, True), "ret").select("symbol", "seq", "target")


@query("m04_volatility_label", f"""
WITH {FUT}, g AS (SELECT *, CASE WHEN count(ret) OVER {fr(50, TP)} >= 50 THEN ret / greatest(stddev_samp(ret) OVER {fr(50, TP)}, 0.0001) END AS x FROM f0), h AS (SELECT * FROM g WHERE ret IS NOT NULL),
q AS (SELECT symbol AS s, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi FROM h GROUP BY 1)
SELECT symbol, seq, CASE WHEN x > hi THEN 1 WHEN x < lo THEN -1 ELSE 0 END AS target FROM h JOIN q ON symbol = s""")
def _(spark, sf):
    x = ds.future_returns(v.ticks(spark, sf), 20, vol_rows=50)
    return ds.label(x, ds.fit_quantiles(x, "ret_per_vol", 0.25, 0.75), "ret_per_vol").select("symbol", "seq", "target")


@query("m05_floored_label", f"""
WITH {FUT}, q AS (SELECT symbol AS s, least(quantile_cont(ret, 0.15), -0.002) AS lo, greatest(quantile_cont(ret, 0.85), 0.002) AS hi FROM f GROUP BY 1)
SELECT symbol, seq, CASE WHEN ret > hi THEN 1 WHEN ret < lo THEN -1 ELSE 0 END AS target FROM f JOIN q ON symbol = s""")
def _(spark, sf):
    x = ds.future_returns(v.ticks(spark, sf), 20)
    return ds.label(x, ds.with_floor(ds.fit_quantiles(x, "ret", 0.15, 0.85), 0.002), "ret").select("symbol", "seq", "target")


@query("m07_book_targets", f"""
WITH {RAW_TOPS}, a AS (SELECT *, ask - bid AS sp, (ask + bid) / 2 AS mid, (bid_qty - ask_qty) / (bid_qty + ask_qty) AS im, bid_qty + ask_qty AS dp, {flag("bid_qty < 10 OR ask_qty < 10")} AS sw FROM tops)
SELECT k, ts, {r(f"lead(sp) OVER ({K})")} AS spread_next, CAST(sp > -50 AS INT) + CAST(sp > 0 AS INT) + CAST(sp > 50 AS INT) AS spread_class, {r(f"lead(im) OVER ({K})")} AS imbalance_next,
 CASE WHEN im <= -0.6 THEN 'strong_sell' WHEN im <= -0.2 THEN 'sell' WHEN im <= 0.2 THEN 'neutral' WHEN im <= 0.6 THEN 'buy' ELSE 'strong_buy' END AS imbalance_class,
 {r(f"last_value(mid) OVER ({K} RANGE BETWEEN CURRENT ROW AND INTERVAL 21600 SECONDS FOLLOWING) / mid - 1")} AS price_move, {r(f"lead(dp) OVER ({K}) / dp - 1")} AS consumption,
 CASE WHEN count(*) OVER ({K} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) >= 10 THEN max(sw) OVER ({K} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) END AS sweep_coming FROM a""")
def _(spark, sf):
    return ds.book_targets(tops(spark, sf), 21600, [-50, 0, 50], 10).select(
        "k", "ts", "spread_class", "imbalance_class", "sweep_coming", *[rd(c).alias(c) for c in ("spread_next", "imbalance_next", "price_move", "consumption")])


@query("m08_chronological_split", f"""
WITH a AS (SELECT symbol, seq, row_number() OVER ({TP}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
SELECT symbol, seq, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM a""")
def _(spark, sf):
    return ds.split(ro.layout(v.ticks(spark, sf)), 0.7, 0.15).select("symbol", "seq", "split")


def _periods(bounds):
    return f"""WITH s AS (SELECT symbol, count(*) AS n, list(ts ORDER BY ts, seq) AS l FROM ticks GROUP BY 1), f AS ({bounds})
SELECT symbol, fold, train_from, train_to, test_from, test_to, l[train_from + 1] AS train_start, l[train_to] AS train_end, l[test_from + 1] AS test_start, l[test_to] AS test_end,
 {flag("l[train_to] >= l[test_from + 1]")} AS leak FROM f"""


def _folds(spark, sf, kind, **p):
    o = ro.layout(v.ticks(spark, sf))
    return ds.fold_periods(o, ds.fold_bounds(o.sizes(), kind, **p)).select(
        F.col("_key.symbol").alias("symbol"), "fold", "train_from", "train_to", "test_from", "test_to", "train_start", "train_end", "test_start", "test_end", "leak")


WALK = "SELECT symbol, l, k AS fold, {start} AS train_from, 100 + k * 20 AS train_to, 100 + k * 20 AS test_from, 120 + k * 20 AS test_to FROM s, range(0, 1000) t(k) WHERE 120 + k * 20 <= n"


@query("m09_walk_forward_folds", _periods(WALK.format(start="k * 20")))
def _(spark, sf):
    return _folds(spark, sf, "walk_forward", initial=100, step=20, test=20)


@query("m09_expanding_folds", _periods(WALK.format(start="0::BIGINT")))
def _(spark, sf):
    return _folds(spark, sf, "expanding", initial=100, step=20, test=20)


@query("m11_m12_series_folds", _periods("""SELECT symbol, l, k AS fold, 0::BIGINT AS train_from, n - t + k * e AS train_to, n - t + k * e AS test_from, least(n - t + k * e + e, n) AS test_to
 FROM (SELECT symbol, l, n, CAST(floor(n * 20 / 100) AS BIGINT) AS t, CAST(floor(floor(n * 20 / 100) / 5) AS BIGINT) AS e FROM s), range(0, 5) r(k)"""))
def _(spark, sf):
    return _folds(spark, sf, "series", folds=5, test_pct=20)


@query("m10_purged_folds", """
WITH s AS (SELECT symbol, count(*) AS n, CAST(floor(count(*) / 5) AS BIGINT) AS z FROM ticks GROUP BY 1), f AS (SELECT symbol, n, k AS fold, k * z AS a, least((k + 1) * z, n) AS b FROM s, range(0, 5) t(k))
SELECT symbol, fold, a AS test_from, b AS test_to, greatest(a - 10, 0) AS train_before, greatest(n - (b + 5), 0) AS train_after, greatest(a - 10, 0) + greatest(n - (b + 5), 0) AS train_rows FROM f""")
def _(spark, sf):
    o = ro.layout(v.ticks(spark, sf))
    b = ds.fold_bounds(o.sizes(), "purged", folds=5, purge=10, embargo=5)
    return b.select(F.col("_key.symbol").alias("symbol"), "fold", "test_from", "test_to", "train_before", "train_after", "train_rows")


@query("m10_combinatorial_folds", f"""
WITH r AS (SELECT symbol, CAST(floor((row_number() OVER ({TP}) - 1) * 5 / count(*) OVER (PARTITION BY symbol)) AS BIGINT) AS g FROM ticks), c AS (SELECT symbol, g, count(*) AS c FROM r GROUP BY 1, 2),
k AS (SELECT a.i AS i, b.i AS j FROM range(0, 5) a(i), range(0, 5) b(i) WHERE a.i < b.i)
SELECT symbol, i || '-' || j AS held_out, CAST(sum(CASE WHEN g IN (i, j) THEN c ELSE 0 END) AS BIGINT) AS test_rows,
 CAST(sum(CASE WHEN g IN (i, j) THEN 0 ELSE greatest(c - CASE WHEN g - 1 IN (i, j) THEN 5 ELSE 0 END - CASE WHEN g + 1 IN (i, j) THEN 10 ELSE 0 END, 0) END) AS BIGINT) AS train_rows FROM c, k GROUP BY 1, 2""")
def _(spark, sf):
    return ds.combinatorial_folds(ro.layout(v.ticks(spark, sf)), 5, 2, 10, 5).select(F.col("_key.symbol").alias("symbol"), "held_out", "test_rows", "train_rows")


TRAIN = "ts < TIMESTAMP '2024-01-20'"
SCALERS = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"), "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}
for _kind, (_c, _s) in SCALERS.items():
    def _scaled(spark, sf, kind=_kind):
        b = v.bars(spark, sf)
        fitted = ds.fit_scaler(b.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp")), ["close", "volume"], kind)
        return ds.scale(b, fitted, ["close", "volume"]).select("symbol", "ts", rd("close_scaled").alias("close_scaled"), rd("volume_scaled").alias("volume_scaled"))
    query(f"m13_scale_{_kind}", f"""
WITH p AS (SELECT {_c.format(c="close")} AS cc, {_s.format(c="close")} AS cs, {_c.format(c="volume")} AS vc, {_s.format(c="volume")} AS vs FROM bars WHERE {TRAIN})
SELECT symbol, ts, {r("(close - cc) / cs")} AS close_scaled, {r("(volume - vc) / vs")} AS volume_scaled FROM bars, p""")(_scaled)


@query("m14_label_codes", "SELECT seq, dense_rank() OVER (ORDER BY buy_agent) - 1 AS buy_agent_code FROM ticks")
def _(spark, sf):
    return ds.encode(v.ticks(spark, sf), "buy_agent").select("seq", "buy_agent_code")


FEATURES = ["trades", "range", "volume"]
LAB = "l AS (SELECT trades, high - low AS range, volume, CASE WHEN lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts) > close THEN 1 ELSE 0 END AS y FROM bars)"


def _labelled(spark, sf):
    w = by_time("symbol")
    return v.bars(spark, sf).select("symbol", "ts", "trades", (F.col("high") - F.col("low")).alias("range"), "volume",
                                    F.coalesce((F.lead("close").over(w) > F.col("close")).cast("int"), F.lit(0)).alias("y"))


def _edges(c):
    return f"(SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM l)"


SCORES = f"WITH {LAB}, u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, len(list_filter({_edges(c)}, lambda e: {c}::DOUBLE > e)) AS b, y, {c}::DOUBLE AS x FROM l" for c in FEATURES) + """),
c AS (SELECT feature, b, y, count(*)::DOUBLE AS n FROM u GROUP BY 1, 2, 3), d AS (SELECT *, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS t FROM c),
m AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi, sum(n * n * t / (nb * ny)) - max(t) AS chi FROM d GROUP BY 1),
g AS (SELECT feature, y, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM u GROUP BY 1, 2),
f AS (SELECT feature AS fe, ((sum(sx * sx / n) - sum(sx) * sum(sx) / sum(n)) / (count(*) - 1)) / ((sum(sxx) - sum(sx * sx / n)) / (sum(n) - count(*))) AS fs FROM g GROUP BY 1),
z AS (SELECT feature, mi, chi, fs FROM m JOIN f ON feature = fe)
"""


@query("m15_feature_scores", SCORES + f"SELECT feature, {r('mi')} AS mutual_information, {r('chi', 5)} AS chi_square, {r('fs', 5)} AS f_score FROM z")
def _(spark, sf):
    return ev.feature_scores(_labelled(spark, sf), FEATURES, "y").select("feature", rd("mutual_information").alias("mutual_information"), rd("chi_square", 5).alias("chi_square"), rd("f_score", 5).alias("f_score"))


@query("m15_combined_ranking", SCORES + f"SELECT feature, {r('mi / (SELECT max(mi) FROM z) * 0.5 + chi / (SELECT max(chi) FROM z) * 0.2 + fs / (SELECT max(fs) FROM z) * 0.3')} AS score FROM z ORDER BY score DESC, feature LIMIT 2")
def _(spark, sf):
    s = ev.feature_scores(_labelled(spark, sf), FEATURES, "y")
    return ev.combined_ranking(s, {"mutual_information": 0.5, "chi_square": 0.2, "f_score": 0.3}, 2).withColumn("score", rd("score"))


@query("m15_model_importances", "SELECT unnest(['range', 'trades', 'volume']) AS feature, 1 AS in_range, 1 AS unit_sum, 1 AS lasso_given")
def _(spark, sf):
    i = learn.importances(_labelled(spark, sf), FEATURES, "y")
    total = i.agg(F.sum("forest").alias("_all"))
    return i.crossJoin(F.broadcast(total)).select("feature", F.col("forest").between(0, 1).cast("int").alias("in_range"),
                                                  (F.abs(F.col("_all") - 1) < 1e-6).cast("int").alias("unit_sum"), (F.col("lasso") >= 0).cast("int").alias("lasso_given"))


@query("m16_class_weights", f"SELECT side, count(*) AS n, {r('(SELECT count(*) FROM ticks) / (3 * count(*))')} AS weight FROM ticks GROUP BY 1")
def _(spark, sf):
    return ds.class_weights(v.ticks(spark, sf), "side").withColumn("weight", rd("weight"))


def _training(spark, sf):
    w = by_time("symbol")
    b = v.bars(spark, sf).withColumn("ret", pct_change(F.col("close"), w))
    b = b.withColumns({"vol": rstd(F.col("ret"), w, 10), "vr": F.col("volume") / rmean(F.col("volume"), w, 10), "imb": (F.col("buy_volume") - F.col("sell_volume")) / F.col("volume")})
    b = ds.bar_labels(b, 1, 0.2).withColumn("label", (F.col("target_class") + 1).cast("double")).na.drop(subset=["ret", "vol", "vr"])
    return b.withColumn("regime", F.when(F.col("vr") > 1, "busy").otherwise("quiet"))


INPUTS = ["ret", "vol", "vr", "imb"]
#: Models learn from earlier rows and are scored on later ones.
SPLIT = "2024-01-22"
#: Rows of the label table: the tenth and later bars of a symbol but its last.
TRAINED = f"""
WITH a AS (SELECT symbol, ts, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
 avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM bars),
t AS (SELECT symbol, ts, CASE WHEN volume / m > 1 THEN 'busy' ELSE 'quiet' END AS regime FROM a WHERE rn >= {{first}} AND rn < n AND ts >= TIMESTAMP '{SPLIT}')
"""


def _split(t, ts="ts"):
    late = F.col(ts) >= F.lit(SPLIT).cast("timestamp")
    return t.where(~late), t.where(late)


def _checked(scored, keys):
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("scored"), F.min(F.col("predicted").isin(0, 1, 2).cast("int")).alias("known_classes"))


@query("m17_m27_regime_forests", TRAINED.format(first=11) + "SELECT regime, count(*) AS scored, 1 AS known_classes FROM t GROUP BY 1")
def _(spark, sf):
    early, late = _split(_training(spark, sf))
    models = learn.per_regime(early, ["busy", "quiet"], INPUTS, "label")
    a, b = (learn.score(models[x], late.where(F.col("regime") == x), ["symbol", "ts", "regime", "label"]) for x in ("busy", "quiet"))
    return _checked(a.unionByName(b), ["regime"])


@query("m17_boosted_classes", TRAINED.format(first=11) + "SELECT symbol, count(*) AS scored, 1 AS known_classes FROM t GROUP BY 1")
def _(spark, sf):
    early, late = _split(_training(spark, sf))
    return _checked(learn.score(learn.boosted(early, INPUTS, "label", rounds=3), late, ["symbol", "ts", "label"]), ["symbol"])


@query("m17_m23_book_regressors", "SELECT unnest(['forest', 'boosted']) AS model, 1 AS scored_all, 1 AS near_the_mean")
def _(spark, sf):
    early, late = _split(ds.book_targets(tops(spark, sf), 21600, [0], 10).na.drop(subset=["spread_next"]))
    models = learn.regressors(early, ["spread", "imbalance", "depth"], "spread_next")
    mean, rows = early.agg(F.avg("spread_next")).first()[0], late.count()
    error = lambda c: F.sqrt(F.avg(F.pow(F.col("spread_next") - c, 2)))
    parts = [learn.score(m, late, ["k", "spread_next"]).agg(
        F.lit(n).alias("model"), (F.count(F.lit(1)) == rows).cast("int").alias("scored_all"),
        (error(F.col("predicted")) <= 1.1 * error(F.lit(mean))).cast("int").alias("near_the_mean")) for n, m in models.items()]
    return parts[0].unionByName(parts[1])


@query("m18_ensemble_votes", f"""
WITH w AS (SELECT avg(CASE WHEN model_a = actual THEN 1 ELSE 0 END) AS wa, avg(CASE WHEN model_b = actual THEN 1 ELSE 0 END) AS wb FROM model_preds)
SELECT id, {flag("(model_a * wa + model_b * wb) / (wa + wb) > 0.5")} AS weighted, {flag("(model_a + model_b) / 2 > 0.5")} AS majority, {flag("model_a = actual OR model_b = actual")} AS any_right FROM model_preds, w""")
def _(spark, sf):
    return ev.ensemble(v.model_preds(spark, sf), ["model_a", "model_b"]).select("id", "weighted", "majority", "any_right")


@query("m18_weight_grid", " UNION ALL ".join(
    f"SELECT {i / 5}::DOUBLE AS weight, {r(f'avg(CASE WHEN (model_a * {i / 5}::DOUBLE + model_b * {1 - i / 5!r}::DOUBLE > 0.5)::INT = actual THEN 1 ELSE 0 END)')} AS accuracy FROM model_preds" for i in range(6)))
def _(spark, sf):
    return ev.weight_grid(v.model_preds(spark, sf), "model_a", "model_b", 5).withColumn("accuracy", rd("accuracy"))


@query("m19_diversity", f"""
WITH a AS (SELECT avg(CASE WHEN model_a <> model_b THEN 1 ELSE 0 END) AS d, corr(model_a, model_b) AS c, sum(CASE WHEN model_a = actual AND model_b = actual THEN 1 ELSE 0 END) AS x, sum(CASE WHEN model_a <> actual AND model_b <> actual THEN 1 ELSE 0 END) AS y,
 sum(CASE WHEN model_a = actual AND model_b <> actual THEN 1 ELSE 0 END) AS e, sum(CASE WHEN model_a <> actual AND model_b = actual THEN 1 ELSE 0 END) AS f, avg(model_a) * avg(model_b) + (1 - avg(model_a)) * (1 - avg(model_b)) AS p FROM model_preds)
SELECT 'model_a' AS model1, 'model_b' AS model2, {r("d")} AS disagreement, {r("c")} AS correlation, {r("(x * y - e * f) / (x * y + e * f)")} AS q, {r("(1 - d - p) / (1 - p)")} AS kappa FROM a""")
def _(spark, sf):
    return ev.diversity(v.model_preds(spark, sf), ["model_a", "model_b"]).withColumns({c: rd(c) for c in ("disagreement", "correlation", "q", "kappa")})


def _cls():
    cells = ", ".join(f"sum(CASE WHEN actual = {c} AND predicted = {c} THEN 1 ELSE 0 END) AS t{c}, sum(CASE WHEN actual = {c} THEN 1 ELSE 0 END) AS s{c}, sum(CASE WHEN predicted = {c} THEN 1 ELSE 0 END) AS p{c}" for c in range(3))
    pr = ", ".join(f"coalesce(t{c} / nullif(p{c}, 0), 0) AS pr{c}, coalesce(t{c} / nullif(s{c}, 0), 0) AS re{c}" for c in range(3))
    f1 = ", ".join(f"coalesce(2 * pr{c} * re{c} / nullif(pr{c} + re{c}, 0), 0) AS f{c}" for c in range(3))
    wt = lambda m: "(" + " + ".join(f"{m}{c} * s{c}" for c in range(3)) + ") / n"
    return f"""WITH a AS (SELECT symbol, count(*) AS n, avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) AS acc, avg(confidence) FILTER (actual = predicted) AS cr, avg(confidence) FILTER (actual <> predicted) AS cw, {cells} FROM predictions GROUP BY 1),
b AS (SELECT *, {pr} FROM a), c AS (SELECT *, {f1} FROM b) SELECT symbol, n, {r("acc")} AS accuracy, {r("cr")} AS confidence_right, {r("cw")} AS confidence_wrong, {r(wt("pr"))} AS precision_weighted, {r(wt("re"))} AS recall_weighted,
 {r(wt("f"))} AS f1_weighted, {r("(f0 + f1 + f2) / 3")} AS f1_macro, {r("pr0")} AS precision_0, {r("re2")} AS recall_2 FROM c"""


@query("m20_classification", _cls())
def _(spark, sf):
    return ev.classification(v.predictions(spark, sf), ["symbol"], [0, 1, 2], confidence="confidence").select("symbol", "n", *[rd(c).alias(c) for c in (
        "accuracy", "confidence_right", "confidence_wrong", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro", "precision_0", "recall_2")])


@query("m20_confusion", "SELECT actual, predicted, count(*) AS n FROM predictions GROUP BY 1, 2")
def _(spark, sf):
    return ev.confusion(v.predictions(spark, sf))


ERR = {"errors": "actual <> predicted", "false_buys": "predicted = 2 AND actual <> 2", "false_sells": "predicted = 0 AND actual <> 0", "missed_buys": "predicted <> 2 AND actual = 2",
       "missed_sells": "predicted <> 0 AND actual = 0", "confident_errors": "actual <> predicted AND confidence > 0.7"}


@query("m21_error_types", "SELECT symbol, " + ", ".join(f"{r(f'sum(CASE WHEN {c} THEN 1 ELSE 0 END)')} AS {n}" for n, c in ERR.items()) + f", {r('avg(CASE WHEN actual <> predicted THEN 1 ELSE 0 END)')} AS error_rate FROM predictions GROUP BY 1")
def _(spark, sf):
    return ev.error_types(v.predictions(spark, sf), ["symbol"], limit=0.7).select("symbol", *[rd(c).alias(c) for c in [*ERR, "error_rate"]])


@query("m22_rolling_accuracy", f"""
WITH a AS (SELECT *, CASE WHEN predicted = actual THEN 1 ELSE 0 END AS h, row_number() OVER ({TP}) AS rn FROM predictions), b AS (SELECT *, CASE WHEN count(*) OVER {fr(100, TP)} >= 20 THEN avg(h) OVER {fr(100, TP)} END AS ac FROM a)
SELECT symbol, seq, {r("ac")} AS accuracy, {r(f"CASE WHEN count(ac) OVER {fr(100, TP)} >= 100 THEN regr_slope(ac, rn) OVER {fr(100, TP)} END", 8)} AS trend FROM b""")
def _(spark, sf):
    return ev.rolling_accuracy(v.predictions(spark, sf), 100, 20).withColumns({"accuracy": rd("accuracy"), "trend": rd("trend", 8)})


@query("m23_regression_metrics", f"""
WITH a AS (SELECT symbol, close, pc FROM barx WHERE pc IS NOT NULL)
SELECT symbol, {r("avg(abs(close - pc))")} AS mae, {r("avg(pow(close - pc, 2))", 4)} AS mse, {r("sqrt(avg(pow(close - pc, 2)))")} AS rmse, {r("1 - avg(pow(close - pc, 2)) / var_pop(close)")} AS r2 FROM a GROUP BY 1""")
def _(spark, sf):
    b = v.bars(spark, sf).withColumn("naive", F.lag("close").over(by_time("symbol"))).where("naive IS NOT NULL")
    return ev.regression(b, ["symbol"], "close", "naive").select("symbol", rd("mae").alias("mae"), rd("mse", 4).alias("mse"), rd("rmse").alias("rmse"), rd("r2").alias("r2"))


@query("m24_drift", f"""
WITH a AS (SELECT *, CASE WHEN predicted = actual THEN 1 ELSE 0 END AS h, row_number() OVER ({TP}) > count(*) OVER (PARTITION BY symbol) - 200 AS nw FROM predictions),
b AS (SELECT symbol, avg(predicted) FILTER (nw) - avg(predicted) FILTER (NOT nw) AS ms, avg(h) FILTER (NOT nw) - avg(h) FILTER (nw) AS ad, avg(confidence) FILTER (NOT nw) - avg(confidence) FILTER (nw) AS cd,
 abs(stddev_samp(confidence) FILTER (nw) / stddev_samp(confidence) FILTER (NOT nw) - 1) AS vc FROM a GROUP BY 1)
SELECT symbol, {r("ms")} AS mean_shift, {r("ad")} AS accuracy_drop, {r("cd")} AS confidence_drop, {r("vc")} AS volatility_change, {flag("ad > 0.1 OR cd > 0.1 OR vc > 0.2")} AS degraded FROM b""")
def _(spark, sf):
    return ev.drift(v.predictions(spark, sf), 200).withColumns({c: rd(c) for c in ("mean_shift", "accuracy_drop", "confidence_drop", "volatility_change")})


@query("m25_agreement", f"""
WITH a AS (SELECT symbol, ts, list_stddev_pop([buy_volume / volume, sell_volume / volume, 0.5::DOUBLE]) AS sd, (CAST(buy_volume <> 0 AS INT) + CAST(sell_volume <> 0 AS INT) + 1) / 3 AS fq FROM bars)
SELECT symbol, ts, {r("1 - least(sd, 1)")} AS agreement, {r("fq")} AS feature_quality, {flag("1 - least(sd, 1) < 0.8 OR fq < 0.5")} AS anomaly FROM a""")
def _(spark, sf):
    b = v.bars(spark, sf).withColumns({"a": F.col("buy_volume") / F.col("volume"), "b": F.col("sell_volume") / F.col("volume"), "c": F.lit(0.5)})
    return ev.agreement(b, ["a", "b", "c"], ["buy_volume", "sell_volume", "close"], 0.8).select("symbol", "ts", rd("agreement").alias("agreement"), rd("feature_quality").alias("feature_quality"), "anomaly")


@query("m26_after_warmup", f"""
SELECT symbol, seq FROM (SELECT *, row_number() OVER ({TP}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ticks) WHERE rn > 50 AND rn > n - 300""")
def _(spark, sf):
    return ds.after_warmup(ro.layout(v.ticks(spark, sf)), 50, 300).select("symbol", "seq")


@query("m28_attached_means", f"SELECT seq, price, m AS mean_depth FROM ticks, (SELECT {r('avg(list_sum(bid_volumes) + list_sum(ask_volumes))')} AS m FROM book_l2)")
def _(spark, sf):
    from tickloom.operators.book import depth
    return ds.attach_means(v.ticks(spark, sf), depth(v.book_l2(spark, sf)), ["total_depth"]).select("seq", "price", rd("mean_total_depth").alias("mean_depth"))


@query("m29_retrain_due", f"""
WITH a AS (SELECT *, CASE WHEN predicted = actual THEN 1.0 ELSE 0 END AS h, row_number() OVER ({TP}) > count(*) OVER (PARTITION BY symbol) - 100 AS l FROM predictions),
b AS (SELECT symbol, (floor(epoch(max(ts))) - epoch(TIMESTAMP '2024-01-25')) / 3600 AS hr, sum(CASE WHEN ts > TIMESTAMP '2024-01-25' THEN 1 ELSE 0 END) AS nr, avg(h) FILTER (l) AS wr FROM a GROUP BY 1)
SELECT symbol, {r("hr")} AS hours, CAST(nr AS BIGINT) AS new_rows, {r("wr")} AS win_rate, {flag("(hr >= 24 AND nr >= 300) OR wr < 0.45")} AS retrain FROM b""")
def _(spark, sf):
    return ev.retrain_due(v.predictions(spark, sf), 24, 300, 100, 0.45, "2024-01-25").withColumns({"hours": rd("hours"), "win_rate": rd("win_rate")})


@query("m30_trading_accuracy", f"""
SELECT symbol, {r("avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) FILTER (actual <> 1)")} AS trading_accuracy, {r("avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END) FILTER (predicted <> 1)")} AS trade_precision,
 {r("avg(confidence) FILTER (predicted <> 1)")} AS trade_confidence, {r("avg(CASE WHEN predicted <> 1 THEN 1 ELSE 0 END)")} AS trade_rate FROM predictions GROUP BY 1""")
def _(spark, sf):
    return ev.trading_accuracy(v.predictions(spark, sf), ["symbol"]).withColumns({c: rd(c) for c in ("trading_accuracy", "trade_precision", "trade_confidence", "trade_rate")})
