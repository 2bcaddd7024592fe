"""Training, tuning, scoring and storing of models with Spark ML; every fit is a distributed job."""

from __future__ import annotations

import itertools
import logging
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import finite
from ..session import cut, stage
from .labels import flatten_sequence
from .scale import time_folds
from .selection import correlated_features, correlation_matrix

log = logging.getLogger(__name__)

# default hyper-parameters (fixed values)
FOREST = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2, seed=42)
BOOSTED = dict(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)

ESTIMATORS: dict[tuple[str, str], Callable] = {
    ("random_forest", "classification"): lambda **p: RandomForestClassifier(**(FOREST | p)),
    ("random_forest", "regression"): lambda **p: RandomForestRegressor(**(FOREST | p)),
    ("boosted_trees", "classification"): lambda **p: GBTClassifier(**(BOOSTED | p)),
    ("boosted_trees", "regression"): lambda **p: GBTRegressor(**(BOOSTED | p)),
    ("linear", "classification"): lambda **p: LogisticRegression(**p),
    ("linear", "regression"): lambda **p: LinearRegression(**p),
}


def estimator(name: str, kind: str, features: Sequence[str], label: str, **params) -> Pipeline:
    if (name, kind) not in ESTIMATORS:
        raise ValueError(f"unknown model {name} for {kind}")
    columns = {"featuresCol": "features", "labelCol": label, "predictionCol": f"prediction_{name}"}
    model = ESTIMATORS[name, kind](**params, **columns)
    if kind == "classification":
        model.setProbabilityCol(f"probability_{name}").setRawPredictionCol(f"raw_{name}")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, model])


def training_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with every feature and the label, stored once since each fit reads them many times."""
    keep = [c for c in df.columns if c not in features and c != label]
    # one condition over the raw columns: conditions on the computed ones make the optimizer try all their combinations
    known = F.forall(F.array(*[F.col(c).cast("double") for c in (*features, label)]), lambda x: finite(x).isNotNull())
    return cut(df.filter(known).select(*keep, *[F.col(c).cast("double").alias(c) for c in (*features, label)]))


def train_models(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    models: dict[str, dict],
    kind: str = "classification",
    *,
    parallel: int = 2,
) -> dict[str, PipelineModel]:
    """Fit the named models (name -> parameters) on prepared rows. If some fail, the others are still fitted and then all failures raised."""
    failed: dict[str, Exception] = {}

    def fit(item):
        name, params = item
        try:
            return name, estimator(name, kind, features, label, **params).fit(df)
        except Exception as e:  # told below, with the others
            log.exception("model %s failed", name)
            failed[name] = e
            return name, None

    with ThreadPoolExecutor(parallel) as pool:
        fitted = dict(pool.map(fit, models.items()))
    if failed:
        raise RuntimeError(f"models that could not be fitted: {', '.join(failed)}") from next(iter(failed.values()))
    return fitted


def score(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """All models over one scan: ``pred_<model>`` and, for classifiers, ``prob_<model>`` columns.

    Every row stays; one with a missing (NULL or NaN) feature has NULL scores.
    """
    d = df
    for n, m in models.items():
        d = m.transform(d).drop("features", f"raw_{n}")
    out = []
    for n, m in models.items():
        known = F.lit(True)
        for c in m.stages[0].getInputCols():
            known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        out.append(F.when(known, F.col(f"prediction_{n}")).alias(f"pred_{n}"))
        if f"probability_{n}" in d.columns:
            out.append(F.when(known, vector_to_array(f"probability_{n}")[1]).alias(f"prob_{n}"))
    return d.select(*df.columns, *out)


def long_scores(scored: DataFrame, keys: Sequence[str], label: str, models: Sequence[str], prefix: str = "pred_") -> DataFrame:
    d = scored.select(*keys, F.col(label).cast("double").alias("y"), *[F.col(f"{prefix}{m}").alias(m) for m in models])
    return d.unpivot([*keys, "y"], list(models), "model", "prediction")


def importances(spark: SparkSession, models: dict[str, PipelineModel], features: Sequence[str]) -> DataFrame:
    """(model, feature, importance); linear models give absolute coefficients."""
    rows = []
    for n, m in models.items():
        last = m.stages[-1]
        v = last.featureImportances if hasattr(last, "featureImportances") else getattr(last, "coefficients", None)
        if v is not None:
            rows += [(n, f, float(abs(x))) for f, x in zip(features, v.toArray())]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def select_by_forest(
    df: DataFrame, features: Sequence[str], label: str, *, min_importance: float = 0.001, max_features: int = 30, **params
) -> DataFrame:
    """Forest importances with a decision per feature: kept, or why not."""
    model = estimator("random_forest", "classification", features, label, **params).fit(df)
    ranked = importances(df.sparkSession, {"random_forest": model}, features).drop("model")
    # one row per feature
    order = F.struct((-F.col("importance")).alias("i"), "feature")
    all_rows = ranked.agg(F.array_sort(F.collect_list(order)).alias("_a")).select(F.posexplode("_a").alias("_p", "_e"))
    imp = -F.col("_e.i")
    reason = F.when(imp < min_importance, "low importance").when(F.col("_p") >= max_features, "beyond the feature limit").otherwise("kept")
    return all_rows.select(F.col("_e.feature").alias("feature"), imp.alias("importance"), (F.col("_p") + 1).alias("rank"), reason.alias("decision"))


def select_features(
    df: DataFrame, features: Sequence[str], label: str, *, threshold: float = 0.95, min_importance: float = 0.001, max_features: int = 30, **params
) -> DataFrame:
    """The log of a selection, one row per feature: (feature, decision, value, correlated_with, rank).

    Features that an earlier column explains (absolute correlation above ``threshold``) go first, ``value`` is that correlation; a forest
    on the rest ranks by importance and keeps the best. Pass training rows only. Correlations are over the rows that have both
    columns, the forest takes the rows that have all that are left.
    """
    matrix = stage(correlation_matrix(df, features), "correlations")
    removed = stage(correlated_features(matrix, threshold), "correlated")
    gone = {r["feature"] for r in removed.select("feature").collect()}  # one row per removed feature
    left = [f for f in features if f not in gone]
    ranked = select_by_forest(training_rows(df, left, label), left, label, min_importance=min_importance, max_features=max_features, **params)
    log_of = removed.select(
        "feature", F.lit("correlated").alias("decision"), F.col("correlation").alias("value"), "correlated_with", F.lit(None).cast("int").alias("rank")
    )
    return log_of.unionByName(ranked.select("feature", "decision", F.col("importance").alias("value"), F.lit(None).cast("string").alias("correlated_with"), "rank"))


def selected(log_of: DataFrame) -> list[str]:
    """The kept features of a selection's log, best first."""
    return [r["feature"] for r in log_of.filter("decision = 'kept'").orderBy("rank").select("feature").collect()]


def tune(
    df: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    grid: dict[str, Sequence],
    *,
    kind: str = "classification",
    folds: int = 3,
    search: str = "grid",
    n_iter: int = 10,
    seed: int = 42,
    by: Sequence[str] = (),
    ts: str = "ts",
    parallel: int = 2,
) -> DataFrame:
    """(params, fold, score) over time-ordered folds: each fold trains on the past of what it tests.

    One model is fitted to all series, so by default the folds are cut at common times. Score: accuracy, or negative mean squared error.
    """
    combos = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if search == "random" and n_iter < len(combos):
        combos = random.Random(seed).sample(combos, n_iter)
    rows = cut(time_folds(df, folds, by=by, ts=ts))
    spark = df.sparkSession

    def run(job):
        params, fold = job
        part = rows.filter(F.col("fold") == fold)
        model = estimator(name, kind, features, label, **params).fit(part.filter("role = 'train'"))
        d = model.transform(part.filter("role = 'test'"))
        p, y = F.col(f"prediction_{name}"), F.col(label)
        value = F.avg((p == y).cast("double")) if kind == "classification" else -F.avg((p - y) * (p - y))
        return str(params), fold, float(d.agg(value).first()[0])

    with ThreadPoolExecutor(parallel) as pool:
        out = list(pool.map(run, [(c, f) for c in combos for f in range(1, folds + 1)]))
    return spark.createDataFrame(out, "params string, fold int, score double")


def best_params(tuned: DataFrame) -> DataFrame:
    mean = tuned.groupBy("params").agg(F.avg("score").alias("score"))
    return mean.agg(F.max(F.struct("score", "params")).alias("_b")).select("_b.params", "_b.score")


def save_models(models: dict[str, PipelineModel], path: str, version: str, features: Sequence[str]) -> None:
    """One folder per version and model, and a table that describes them."""
    spark = SparkSession.getActiveSession()
    rows = []
    for n, m in models.items():
        m.write().overwrite().save(f"{path}/{version}/models/{n}")
        rows.append((version, n, type(m.stages[-1]).__name__, list(features)))
    table = spark.createDataFrame(rows, "version string, model string, class string, features array<string>")
    table.write.mode("overwrite").json(f"{path}/{version}/summary")


def load_models(spark: SparkSession, path: str, version: str) -> dict[str, PipelineModel]:
    names = [r["model"] for r in model_summary(spark, path, version).collect()]  # one row per model
    return {n: PipelineModel.load(f"{path}/{version}/models/{n}") for n in names}


def model_summary(spark: SparkSession, path: str, version: str = "*") -> DataFrame:
    return spark.read.schema("version string, model string, class string, features array<string>").json(f"{path}/{version}/summary")


def fit_sequence_classifier(df: DataFrame, label: str, *, seq: str = "seq", hidden: Sequence[int] = (), seed: int = 42, max_iter: int = 50):
    """Classifier on flattened lookback windows: logistic regression, or a perceptron with the given hidden layers.

    Returns (model, prepared rows); prepare other rows with ``sequence_vectors``.
    """
    d = cut(sequence_vectors(df, seq).withColumn(label, F.col(label).cast("double")).dropna(subset=[label]))
    columns = {"featuresCol": "x", "labelCol": label}
    if hidden:
        width = len(d.select("x").first()[0])
        est = MultilayerPerceptronClassifier(layers=[width, *hidden, 2], seed=seed, maxIter=max_iter, **columns)
    else:
        est = LogisticRegression(maxIter=max_iter, **columns)
    return est.fit(d), d


def sequence_vectors(df: DataFrame, seq: str = "seq") -> DataFrame:
    d = flatten_sequence(df, seq, "_flat")
    return d.withColumn("x", array_to_vector("_flat")).drop("_flat", seq)
