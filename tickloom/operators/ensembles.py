"""Ensembles over prediction columns: voting, weight search, stacking, blending."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import attach
from .scale import split_two, time_folds
from .series import By


def check_models(models: dict[str, PipelineModel]) -> None:
    """An ensemble needs at least one fitted model, all classifiers or all regressors."""
    if not models:
        raise ValueError("no models")
    if any(not isinstance(m, PipelineModel) for m in models.values()):
        raise ValueError("every model must be fitted")
    kinds = {hasattr(m.stages[-1], "numClasses") for m in models.values()}
    if len(kinds) > 1:
        raise ValueError("classifiers and regressors cannot be mixed")


def vote(wide: DataFrame, models: Sequence[str], weights: dict[str, float] | None = None, *, prefix: str = "pred_", out: str = "ensemble") -> DataFrame:
    """Weighted mean of the models' predictions in each row (equal weights by default)."""
    w = {m: 1.0 for m in models} if weights is None else weights
    total = sum(w[m] for m in models)
    return wide.withColumn(out, sum((F.col(f"{prefix}{m}") * (w[m] / total) for m in models), F.lit(0.0)))


def vote_long(long: DataFrame, weights: dict[str, float] | None = None, *, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """The same over rows (keys, model, prediction)."""
    if weights is None:
        w = F.lit(1.0)
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.try_element_at(table, F.col("model")), F.lit(0.0))
    return long.groupBy(*keys).agg(F.try_divide(F.sum(F.col("prediction") * w), F.sum(w)).alias("ensemble"))


def simplex(n: int, step: float = 0.1, min_weight: float = 0.0) -> list[tuple[float, ...]]:
    """All weight vectors on a grid that sum to 1 and keep to the least weight."""
    parts, least = round(1.0 / step), max(0, math.ceil(min_weight / step - 1e-9))
    free = parts - n * least
    if free < 0:
        return []
    # where n - 1 dividers stand among the free parts: only sums of 1 are made
    cuts = itertools.combinations(range(free + n - 1), n - 1)
    edges = ((-1, *c, free + n - 1) for c in cuts)
    return [tuple(round((b - a - 1 + least) * step, 10) for a, b in zip(e, e[1:])) for e in edges]


def _grid_table(spark: SparkSession, n: int, step: float, min_weight: float) -> DataFrame:
    rows = [(i, list(v)) for i, v in enumerate(simplex(n, step, min_weight))]
    return spark.createDataFrame(rows, "weight_id int, weights array<double>")


def search_weights_mse(wide: DataFrame, models: Sequence[str], y: str = "y", *, step: float = 0.1, min_weight: float = 0.0, prefix: str = "pred_") -> DataFrame:
    """(weight_id, weights, mse) of every grid point, from one pass over the rows.

    The mean squared error is quadratic in the weights, so the means of products of predictions and outcome are
    all that is needed from the data.
    """
    p = [F.col(f"{prefix}{m}") for m in models]
    k = len(models)
    moments = wide.agg(
        F.avg(F.col(y) * F.col(y)).alias("_yy"),
        *[F.avg(p[i] * F.col(y)).alias(f"_y{i}") for i in range(k)],
        *[F.avg(p[i] * p[j]).alias(f"_p{i}_{j}") for i in range(k) for j in range(i, k)],
    )
    w = [F.col("weights")[i] for i in range(k)]
    mse = F.col("_yy")
    for i in range(k):
        mse = mse - 2.0 * w[i] * F.col(f"_y{i}") + w[i] * w[i] * F.col(f"_p{i}_{i}")
        for j in range(i + 1, k):
            mse = mse + 2.0 * w[i] * w[j] * F.col(f"_p{i}_{j}")
    grid = _grid_table(wide.sparkSession, k, step, min_weight)
    return attach(grid, moments).select("weight_id", "weights", mse.alias("mse"))


#: Products of predictions and weights that a task holds at once.
CHUNK = 4_000_000


def search_weights_sharpe(
    wide: DataFrame, models: Sequence[str], ret: str = "ret", *, step: float = 0.1, min_weight: float = 0.0,
    limit: float = 0.5, prefix: str = "prob_", ppy: int = 252,
) -> DataFrame:
    """(weight_id, weights, sharpe) when the row is held if the weighted probability is above the limit.

    Rows with the same predictions are one pattern with its count, sum and squares of returns. Patterns meet the grid as a matrix product
    inside the tasks, which make the grid by its rule and give one row per grid point; neither the plan nor the shuffle holds rows x grid.
    A row without return counts as one that earns nothing; one with a missing prediction is not held.
    """
    k = len(models)
    p = [F.coalesce(F.col(f"{prefix}{m}").cast("double"), F.lit(float("-inf"))).alias(f"p{i}") for i, m in enumerate(models)]
    r = F.coalesce(F.col(ret), F.lit(0.0))
    patterns = wide.select(*p, r.alias("r")).groupBy(*[f"p{i}" for i in range(k)]).agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))

    def run(batches):
        grid = np.array(simplex(k, step, min_weight)).reshape(-1, k)
        sums, rows = np.zeros((len(grid), 2)), 0
        width = max(1, CHUNK // max(1, len(grid)))
        for b in batches:
            x = np.column_stack([b.column(f"p{i}").to_numpy(zero_copy_only=False) for i in range(k)])
            earned = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "q")])
            rows += int(b.column("n").to_numpy(zero_copy_only=False).sum())
            known = np.isfinite(x).all(axis=1)
            x, earned = x[known], earned[known]
            for at in range(0, len(x), width):
                mix = sum(np.outer(x[at : at + width, i], grid[:, i]) for i in range(k))  # in the order of the models
                sums += (mix > limit).T.astype(float) @ earned[at : at + width]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array([rows] * len(grid), pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["weight_id", "n", "s", "q"])

    total = patterns.mapInArrow(run, "weight_id int, n long, s double, q double").groupBy("weight_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.try_divide(F.col("s"), F.col("n"))
    variance = F.try_divide(F.col("q") - F.col("s") * mean, F.col("n") - 1)
    sharpe = F.when(variance > 0, mean / F.sqrt(F.when(variance > 0, variance)) * math.sqrt(ppy)).otherwise(0.0)
    grid = _grid_table(wide.sparkSession, k, step, min_weight)
    return grid.join(total, "weight_id", "left").select("weight_id", "weights", sharpe.alias("sharpe"))


def best_weights(searched: DataFrame, objective: str = "mse") -> DataFrame:
    """The best grid point (the first of equals)."""
    key = F.struct(F.col(objective) if objective == "mse" else (-F.col(objective)).alias(objective), F.col("weight_id"))
    return searched.agg(F.min_by(F.struct(*searched.columns), key).alias("_b")).select("_b.*")


def _meta(models: Sequence[str], y: str, reg: float, elastic: float, prefix: str) -> Pipeline:
    cols = [f"{prefix}{m}" for m in models]
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=cols, outputCol="meta_features"),
            LinearRegression(featuresCol="meta_features", labelCol=y, predictionCol="ensemble", regParam=reg, elasticNetParam=elastic),
        ]
    )


META = {"linear": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (1.0, 1.0)}


def stack(
    scored: DataFrame, models: Sequence[str], y: str = "y", *, k: int = 3, meta: str = "linear", alpha: float | None = None,
    by: By = ("symbol",), ts: str = "ts", prefix: str = "pred_",
) -> PipelineModel:
    """Meta model on the fitted base models' predictions for the rows of the test folds; earlier rows count as 0."""
    reg, elastic = META[meta]
    reg = reg if alpha is None else alpha
    tested = time_folds(scored, k, by=by, ts=ts).filter("role = 'test'").select(*by, ts, F.lit(True).alias("_tested"))
    d = scored.join(tested, [*by, ts], "left")
    cols = {f"{prefix}{m}": F.when(F.col("_tested"), F.col(f"{prefix}{m}")).otherwise(0.0) for m in models}
    return _meta(models, y, reg, elastic, prefix).fit(d.withColumns(cols))


def blend(
    scored: DataFrame, models: Sequence[str], y: str = "y", *, holdout: float = 0.2, by: By = ("symbol",), ts: str = "ts", prefix: str = "pred_"
) -> PipelineModel:
    """Linear meta model on the last rows of each series."""
    d = split_two(scored, holdout, by=by, ts=ts).filter("split = 'test'")
    return _meta(models, y, 0.0, 0.0, prefix).fit(d)


def combine(model: PipelineModel, scored: DataFrame) -> DataFrame:
    return model.transform(scored).drop("meta_features")
