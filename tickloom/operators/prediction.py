"""Quality of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import div, share
from ..session import cut
from .series import By, rolling


def regression_metrics(df: DataFrame, y: str = "y", p: str = "prediction", *, by: By = ()) -> DataFrame:
    """Errors, R2 and the percentage error (rows with y = 0 left out of it)."""
    e = F.col(p) - F.col(y)
    sse = F.sum(e * e)
    return df.groupBy(*by).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1.0 - div(sse, F.var_pop(F.col(y)) * F.count(y))).alias("r2_score"),
        F.avg(e).alias("mean_error"),
        F.stddev_pop(e).alias("std_error"),
        (F.avg(F.abs(div(e, F.col(y)))) * 100.0).alias("mape"),
    )


def direction_accuracy(df: DataFrame, y: str = "y", p: str = "prediction", *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """How often prediction and outcome move the same way from row to row."""
    d = rolling(df, lambda w: {"dy_": F.col(y) - w.lag(y), "dp_": F.col(p) - w.lag(p)}, before=1, by=by, ts=ts)
    return d.groupBy(*by).agg(share(F.signum("dy_") == F.signum("dp_")).alias("direction_accuracy"))


def confusion(df: DataFrame, y: str = "y", p: str = "prediction", *, by: By = ()) -> DataFrame:
    return df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "prediction", *, positive=1, by: By = ()) -> DataFrame:
    """Accuracy, precision, recall, F1: of the positive class, or weighted by class size when there are more than two.

    Works on confusion counts, at most classes x classes rows per key. A ratio with nothing below the line is 0.
    """
    n = F.col("n")
    hit = F.when(F.col(y) == F.col(p), n).otherwise(0)
    none = F.lit(0).cast("long")
    # a confusion cell adds to the class of its outcome and to the class of its prediction
    sides = F.array(
        F.struct(F.col(y).cast("double").alias("_k"), hit.cast("long").alias("tp"), none.alias("pp"), n.alias("ap")),
        F.struct(F.col(p).cast("double").alias("_k"), none.alias("tp"), n.alias("pp"), none.alias("ap")),
    )
    per = (
        confusion(df, y, p, by=by)
        .select(*by, F.explode(sides).alias("_s"))
        .groupBy(*by, F.col("_s._k").alias("_k"))
        .agg(F.sum("_s.tp").alias("_tp"), F.sum("_s.pp").alias("_pp"), F.sum("_s.ap").alias("_ap"))
    )
    zero = F.lit(0.0)
    per = per.withColumns(
        {
            "_prec": F.coalesce(div(F.col("_tp"), F.col("_pp")), zero),
            "_rec": F.coalesce(div(F.col("_tp"), F.col("_ap")), zero),
            "_f1": F.coalesce(div(2.0 * F.col("_tp"), F.col("_pp") + F.col("_ap")), zero),
        }
    )

    def chosen(x: str):
        weighted = div(F.sum(F.col(x) * F.col("_ap")), F.sum("_ap"))
        binary = F.max(F.when(F.col("_k") == positive, F.col(x)))
        return F.when(F.count_if(F.col("_ap") > 0) > 2, weighted).otherwise(F.coalesce(binary, zero))

    return per.groupBy(*by).agg(
        (F.sum("_tp") / F.sum("_ap")).alias("accuracy"),
        chosen("_prec").alias("precision"),
        chosen("_rec").alias("recall"),
        chosen("_f1").alias("f1_score"),
    )


def score_ranges(scores: DataFrame, by: By, parts: int) -> DataFrame:
    """Stored rows with ``_cell``, the number of the range of (by, _s) they lie in; ranges hold about equal numbers of rows.

    Ranges come from a sample of the rows themselves, so crowded scores get more of them.
    """
    return cut(scores.repartitionByRange(parts, *by, "_s").withColumn("_cell", F.spark_partition_id()))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", *, by: By = ()) -> DataFrame:
    """Area under the ROC curve of a 0/1 label by the rank sum with mid-ranks for ties.

    Rows collapse to counts per distinct score first. These are dealt by ranges of score and ranked in two levels, the ranges
    below and the rows inside, so no task sorts more than its share however the scores are spread. Rows without label or score
    do not count.
    """
    s = df.filter(F.col(y).isNotNull()).select(*by, F.col(y).alias("_y"), F.col(score).cast("double").alias("_s")).filter("_s IS NOT NULL")
    s = s.groupBy(*by, "_s").agg(F.sum((F.col("_y") == 1).cast("long")).alias("_p"), F.sum((F.col("_y") == 0).cast("long")).alias("_q"))
    d = score_ranges(s, by, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    below = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range
    cells = d.groupBy(*by, "_cell").agg(F.sum("_q").alias("_c")).select(
        *by, "_cell", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*by, "_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(cells, [*by, "_cell"]).withColumn("_under", F.col("_off") + F.coalesce(F.sum("_q").over(inside), F.lit(0)))
    wins = F.sum(F.col("_p") * (F.col("_under") + F.col("_q") / 2.0))
    return d.groupBy(*by).agg(div(wins, F.sum("_p") * F.sum("_q").cast("double")).alias("auc"))


def roc_auc_ovr(df: DataFrame, y: str, scores: dict[str, str], *, by: By = ()) -> DataFrame:
    """One-versus-rest AUC per class (class value -> score column), weighted by class size."""
    parts = None
    for k, col in scores.items():
        one = df.select(*by, F.lit(str(k)).alias("_k"), (F.col(y).cast("string") == str(k)).cast("int").alias("y"), F.col(col).alias("score"))
        parts = one if parts is None else parts.unionByName(one)
    auc = roc_auc(parts, by=(*by, "_k"))
    size = parts.groupBy(*by, "_k").agg(F.sum("y").alias("_n"))
    return auc.join(size, [*by, "_k"]).groupBy(*by).agg(div(F.sum(F.col("auc") * F.col("_n")), F.sum("_n")).alias("auc"))


def log_loss(df: DataFrame, y: str = "y", score: str = "score", *, by: By = (), eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    return df.groupBy(*by).agg((-F.avg(F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1.0 - p)))).alias("log_loss"))


def model_scores(long: DataFrame, y: str = "y", p: str = "prediction", *, kind: str = "regression", by: Sequence[str] = ("model",)) -> DataFrame:
    """MSE (regression) or accuracy (classification) of each model in a long prediction table."""
    e = F.col(p) - F.col(y)
    value = F.avg(e * e) if kind == "regression" else share(F.col(p) == F.col(y))
    return long.groupBy(*by).agg(value.alias("mse" if kind == "regression" else "accuracy"))
