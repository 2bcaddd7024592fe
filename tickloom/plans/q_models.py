"""Registered queries: model training, selection, tuning, storing, ensembles. Fits are seeded."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import ensembles, indicators, labels, models, prediction, scale, selection
from ..session import cut
from ..sources.files import scratch
from .catalog import register, show
from .fixtures import SUPP, flag_bars, hour_bars, supp_bars
from .q_trading import long_predictions, wide_predictions

FEATURES = ("return_1d", "return_5d", "price_ma_distance_5", "price_ma_distance_20", "volatility_5d", "daily_range")
FOREST = {"numTrees": 10, "maxDepth": 5}
BOOSTED = {"maxIter": 5, "maxDepth": 4}


def dataset(s, d):
    """Features and next-bar direction of all suppliers, split at one time."""
    b = indicators.add_features(supp_bars(s, d), "returns", "price_ma_distance", "volatility", "bar_shape")
    b = labels.add_labels(b, 1).withColumn("ret", F.col("future_return_1d"))
    b = b.select("symbol", "ts", "ret", "direction", *FEATURES)
    return models.training_rows(scale.split_times(b, 0.2), FEATURES, "direction")


def train(rows, names=None, kind="classification", label="direction"):
    specs = {"random_forest": FOREST, "boosted_trees": BOOSTED, "linear": {"maxIter": 20}}
    return models.train_models(rows.filter("split = 'train'"), FEATURES, label, {n: specs[n] for n in names or specs}, kind)


def _classifier(name):
    def run(s, d):
        rows = dataset(s, d)
        scored = models.score(train(rows, [name]), rows.filter("split = 'test'"))
        return show(scored, ["symbol", "ts"], 6, [f"pred_{name}", f"prob_{name}"])

    return run


register("q01_random_forest", _classifier("random_forest"))
register("q02_boosted_trees", _classifier("boosted_trees"))


def _regressors(s, d):
    rows = dataset(s, d)
    scored = models.score(train(rows, ["random_forest", "boosted_trees"], "regression", "ret"), rows.filter("split = 'test'"))
    long = models.long_scores(scored, ["symbol", "ts"], "ret", ["random_forest", "boosted_trees"])
    return prediction.regression_metrics(long, by=("model",))


register("q01_regression_models", _regressors)


def _scored(s, d):
    rows = dataset(s, d)
    fitted = train(rows)
    ensembles.check_models(fitted)
    return cut(models.score(fitted, rows.filter("split = 'test'"))), list(fitted)


def _train_set(s, d):
    scored, names = _scored(s, d)
    long = models.long_scores(scored, ["symbol", "ts"], "direction", names)
    return prediction.classification_metrics(long, by=("model",), positive=1.0)


register("q03_train_models", _train_set)
register(
    "q04_tune",
    lambda s, d: models.tune(dataset(s, d), "random_forest", FEATURES, "direction", {"numTrees": [5, 10], "maxDepth": [3, 5]}, folds=2, search="random", n_iter=2),
)
register("q05_importance", lambda s, d: models.importances(s, train(dataset(s, d)), FEATURES))


def _store(s, d):
    rows = dataset(s, d)
    fitted = train(rows, ["random_forest", "linear"])
    path = scratch(s, "models")
    models.save_models(fitted, path, "v1", FEATURES)
    again = models.load_models(s, path, "v1")
    test = rows.filter("split = 'test'")
    a, b = models.score(fitted, test), models.score(again, test)
    same = a.join(b.withColumnsRenamed({f"prob_{n}": f"back_{n}" for n in fitted}), ["symbol", "ts"])
    wrong = [F.count_if(F.col(f"prob_{n}") != F.col(f"back_{n}")).alias(n) for n in fitted]
    return same.agg(F.count(F.lit(1)).alias("rows"), *wrong)


register("q06_save_and_load", _store)
register(
    "q07_vote",
    lambda s, d: show(ensembles.vote(wide_predictions(s, d), ["trend", "calm", "busy"], {"trend": 2.0, "calm": 1.0, "busy": 1.0}), ["symbol", "ts"], 6, ["ensemble"]),
    f"WITH {SUPP}, n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nc FROM bars) SELECT symbol, ts, "
    "round((2.0 * CASE WHEN close > open THEN 1 ELSE 0 END + CASE WHEN high / low < 3 THEN 1 ELSE 0 END + CASE WHEN volume > 40 THEN 1 ELSE 0 END) / 4, 6)::DOUBLE AS ensemble "
    "FROM n WHERE nc IS NOT NULL",
)
register(
    "q07_vote_long",
    lambda s, d: show(ensembles.vote_long(long_predictions(s, d).withColumnRenamed("signal", "prediction")), ["symbol", "ts"], 6, ["ensemble"]),
    f"WITH {SUPP}, n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS nc FROM bars) SELECT symbol, ts, "
    "round((CASE WHEN close > open THEN 1.0 ELSE 0.0 END + CASE WHEN high / low < 3 THEN 1 ELSE 0 END + CASE WHEN volume > 40 THEN 1 ELSE 0 END)::DOUBLE / 3, 6) AS ensemble "
    "FROM n WHERE nc IS NOT NULL",
)
_NAMES = ["trend", "calm", "busy"]
_GRID = ensembles.simplex(3, 0.1)
_GRID_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(_GRID)) + ") AS t(weight_id, w1, w2, w3))"
_WIDE_SQL = (
    f"{SUPP}, n AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS ret FROM bars), "
    "k AS (SELECT ret, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS y, CASE WHEN close > open THEN 1.0 ELSE 0.0 END AS a, CASE WHEN high / low < 3 THEN 1.0 ELSE 0.0 END AS b, "
    "CASE WHEN volume > 40 THEN 1.0 ELSE 0.0 END AS c FROM n WHERE ret IS NOT NULL)"
)
register(
    "q08_weights_mse",
    lambda s, d: show(ensembles.search_weights_mse(wide_predictions(s, d).withColumn("y", (F.col("ret") > 0).cast("double")), _NAMES), ["weight_id"], 6, ["mse"]),
    f"WITH {_WIDE_SQL}, {_GRID_SQL} SELECT CAST(weight_id AS INTEGER) AS weight_id, round(avg(pow(y - (w1 * a + w2 * b + w3 * c), 2)), 6) AS mse FROM k, g GROUP BY 1",
)
# votes below the limit of 0.45 keep sums of tenths off the boundary
register(
    "q08_weights_sharpe",
    lambda s, d: show(ensembles.search_weights_sharpe(wide_predictions(s, d), _NAMES, limit=0.45, prefix="pred_"), ["weight_id"], 6, ["sharpe"]),
    f"WITH {_WIDE_SQL}, {_GRID_SQL}, x AS (SELECT weight_id, CASE WHEN w1 * a + w2 * b + w3 * c > 0.45 THEN ret ELSE 0 END AS x FROM k, g) "
    "SELECT CAST(weight_id AS INTEGER) AS weight_id, round(coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252), 0), 6) AS sharpe FROM x GROUP BY 1",
)
register(
    "q08_best_weights",
    lambda s, d: ensembles.best_weights(
        ensembles.search_weights_mse(wide_predictions(s, d).withColumn("y", (F.col("ret") > 0).cast("double")), _NAMES, min_weight=0.2)
    ).select("weight_id", F.round("mse", 6).alias("mse")),
    f"WITH {_WIDE_SQL}, g AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(ensembles.simplex(3, 0.1, 0.2)))
    + ") AS t(weight_id, w1, w2, w3)), m AS (SELECT CAST(weight_id AS INTEGER) AS weight_id, avg(pow(y - (w1 * a + w2 * b + w3 * c), 2)) AS mse FROM k, g GROUP BY 1) "
    "SELECT weight_id, round(mse, 6) AS mse FROM m ORDER BY m.mse, weight_id LIMIT 1",
)
# ten models, the whole grid of 92,378 points: seven of the ten repeat the first three, shifted
_TEN = [f"m{i}" for i in range(10)]


def _ten(s, d):
    w = wide_predictions(s, d)
    return w.select("ret", *[(F.col(f"pred_{_NAMES[i % 3]}") * (1.0 - i / 20)).alias(f"pred_{m}") for i, m in enumerate(_TEN)])


_TEN_GRID = ", ".join("[" + ", ".join(map(str, v)) + "]" for v in ensembles.simplex(10, 0.25))
register(
    "q08_weights_sharpe_ten",
    lambda s, d: show(ensembles.search_weights_sharpe(_ten(s, d), _TEN, step=0.25, limit=0.4137, prefix="pred_"), ["weight_id"], 6, ["sharpe"]),
    f"WITH {_WIDE_SQL}, g AS (SELECT unnest(range(len(w))) AS weight_id, unnest(w) AS w FROM (SELECT [{_TEN_GRID}] AS w)), "
    "p AS (SELECT a, b, c, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM k GROUP BY ALL), "
    "x AS (SELECT weight_id, n, CASE WHEN " + " + ".join(f"w[{i + 1}] * ({'abc'[i % 3]} * {1.0 - i / 20})" for i in range(10)) + " > 0.4137 THEN 1 ELSE 0 END AS held, s, q FROM p, g), "
    "t AS (SELECT weight_id, sum(n) AS n, sum(held * s) AS s, sum(held * q) AS q FROM x GROUP BY 1) SELECT CAST(weight_id AS INTEGER) AS weight_id, "
    f"round(CASE WHEN q - s * s / n > 0 THEN s / n / sqrt((q - s * s / n) / (n - 1)) * {math.sqrt(252)!r} ELSE 0 END, 6) AS sharpe FROM t",
)
# ten models on the whole grid of tenths: 92,378 points
register(
    "q08_best_of_ten",
    lambda s, d: ensembles.best_weights(ensembles.search_weights_sharpe(_ten(s, d), _TEN, limit=0.4137, prefix="pred_"), "sharpe").select("weight_id", F.round("sharpe", 6).alias("sharpe")),
)


def _meta(fit):
    def run(s, d):
        scored, names = _scored(s, d)
        scored = scored.withColumn("y", F.col("ret"))
        out = ensembles.combine(fit(scored, names), scored)
        return show(out, ["symbol", "ts"], 6, ["ensemble"])

    return run


register("q09_stacking", _meta(lambda sc, n: ensembles.stack(sc, n, meta="ridge", prefix="prob_")))
register("q10_blending", _meta(lambda sc, n: ensembles.blend(sc, n, prefix="prob_")))
def _batch(s, d):
    scored, names = _scored(s, d)
    return models.long_scores(scored, ["symbol", "ts"], "direction", names, "prob_")


register("q11_batch_scores", _batch)


def _sequences(s, d):
    b = labels.add_labels(hour_bars(s, d), 1)
    seq = labels.add_sequences(b, 5, target="direction", offset=0, columns=["open", "close"])
    model, rows = models.fit_sequence_classifier(seq.select("symbol", "ts", "seq", F.col("target")), "target", hidden=[6], max_iter=20)
    return model.transform(rows).select("symbol", "ts", "prediction")


register("q13_sequence_classifier", _sequences)
register(
    "i09_forest_importance",
    lambda s, d: models.select_by_forest(dataset(s, d), FEATURES, "direction", **FOREST),
)


def _select(s, d):
    """The whole feature frame of the first four fifths of the time; the default forest."""
    f = cut(labels.add_labels(selection.feature_frame(flag_bars(s, d)), 1).drop("future_return_1d", "profitable_trade"))
    rows = scale.split_times(f, 0.2).filter("split = 'train'")
    dense = [c for c in selection.dense_columns(rows) if c in selection.feature_columns(rows, exclude=("direction",))]
    return models.select_features(rows, dense, "direction")


register("i10_selection", _select)
