"""Scaling, positional splits, lags and rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import attach
from .series import Blocks, By, Frame, number_rows, number_times, rolling


def _params(method: str, c: str) -> tuple[Column, Column]:
    """(offset, scale) of a column: scaled = (x - offset) / scale."""
    if method == "standard":
        return F.avg(c), F.stddev_pop(c)
    if method == "minmax":
        return F.min(c), F.max(c) - F.min(c)
    if method == "robust":
        return F.percentile(c, 0.5), F.percentile(c, 0.75) - F.percentile(c, 0.25)
    raise ValueError(f"unknown method {method}")


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "standard", *, by: By = ("symbol",)) -> DataFrame:
    """One row of offsets and scales per key; a zero scale counts as 1."""
    aggs = []
    for c in columns:
        offset, scale = _params(method, c)
        aggs += [offset.alias(f"{c}__offset"), F.when(scale == 0, 1.0).otherwise(scale).alias(f"{c}__scale")]
    return df.groupBy(*by).agg(*aggs)


def _with_params(df: DataFrame, params: DataFrame, by: By) -> DataFrame:
    return df.join(params, [*by]) if by else attach(df, params)


def scale(df: DataFrame, params: DataFrame, columns: Sequence[str], *, by: By = ("symbol",)) -> DataFrame:
    d = _with_params(df, params, by)
    return d.select(
        *[((F.col(c) - F.col(f"{c}__offset")) / F.col(f"{c}__scale")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def unscale(df: DataFrame, params: DataFrame, columns: Sequence[str], *, by: By = ("symbol",)) -> DataFrame:
    d = _with_params(df, params, by)
    return d.select(
        *[(F.col(c) * F.col(f"{c}__scale") + F.col(f"{c}__offset")).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def split(
    df: DataFrame,
    fractions: Sequence[float] = (0.7, 0.15, 0.15),
    names: Sequence[str] = ("train", "val", "test"),
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Label each row by its position in time; the parts are contiguous and add up to the series."""
    if abs(sum(fractions) - 1.0) > 1e-6:
        raise ValueError("fractions must sum to 1")
    if blocks is None:
        d = number_rows(df, by, (ts,), None).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    else:
        d = number_rows(df, by, (ts,), blocks).join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), [*by])
    part, bound = None, F.lit(0)
    for f, name in zip(fractions[:-1], names[:-1]):
        bound = bound + F.floor(F.col("_n") * f)
        part = F.when(F.col("_rn") < bound, name) if part is None else part.when(F.col("_rn") < bound, name)
    return d.withColumn("split", part.otherwise(names[-1])).drop("_rn", "_n")


def split_two(df: DataFrame, test_size: float = 0.2, *, by: By = ("symbol",), ts: str = "ts", **kw) -> DataFrame:
    return split(df, (1.0 - test_size, test_size), ("train", "test"), by=by, ts=ts, **kw)


def split_times(df: DataFrame, test_size: float = 0.2, *, ts: str = "ts") -> DataFrame:
    """Label rows train or test at one time for all series, so that a model of several series never trains on what comes after its test begins.

    The cut is a place in the sorted times, which the calendar bounds.
    """
    d = number_times(df, ts, "pos_")
    return attach(d, d.agg((F.max("pos_") + 1).alias("n_"))).select(
        *df.columns, F.when(F.col("pos_") < F.floor(F.col("n_") * (1.0 - test_size)), "train").otherwise("test").alias("split")
    )


def scale_sequences(df: DataFrame, method: str = "minmax", *, seq: str = "seq", train: Column) -> DataFrame:
    """Scale arrays of bar structs per field; parameters come from all steps of the training rows."""
    fields = df.schema[seq].dataType.elementType.fieldNames()
    steps = df.filter(train).select(F.explode(seq).alias("_e")).select("_e.*")
    params = fit_scaler(steps, fields, method, by=())
    d = attach(df, params)
    scaled = F.transform(
        seq, lambda e: F.struct(*[((e[f] - F.col(f"{f}__offset")) / F.col(f"{f}__scale")).alias(f) for f in fields])
    )
    return d.select(*[scaled.alias(c) if c == seq else F.col(c) for c in df.columns])


def add_lags(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int],
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    drop_head: bool = True,
    blocks: Blocks | None = None,
) -> DataFrame:
    """``<col>_lag_<k>`` columns; the first max(lags) rows of a series, which lack them, are dropped."""
    k = max(lags)
    d = rolling(
        df,
        lambda w: {f"{c}_lag_{i}": w.lag(c, i) for c in columns for i in lags} | {"keep_": w.lag(F.lit(1), k).isNotNull()},
        before=k,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    return (d.filter("keep_") if drop_head else d).drop("keep_")


_ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "median": lambda x: F.percentile(x, 0.5),
}


def add_rolling(
    df: DataFrame,
    columns: Sequence[str],
    windows: Sequence[int],
    functions: Sequence[str] = ("mean", "std"),
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    drop_head: bool = True,
    blocks: Blocks | None = None,
) -> DataFrame:
    """``<col>_<function>_<n>`` columns; the first max(windows) - 1 rows of a series are dropped."""
    n = max(windows)

    def step(w: Frame):
        out = {f"{c}_{f}_{k}": w.roll(_ROLLING[f], c, k) for c in columns for k in windows for f in functions}
        return out | {"keep_": F.lit(True) if n == 1 else w.lag(F.lit(1), n - 1).isNotNull()}

    d = rolling(df, step, before=n - 1, by=by, ts=ts, blocks=blocks)
    return (d.filter("keep_") if drop_head else d).drop("keep_")


def time_folds(df: DataFrame, k: int = 3, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Expanding folds: (row, fold, role). Fold i tests the i-th of k equal tail pieces and trains on all rows before it.

    Pieces are cut by the rows of each series, or, with ``by=()``, at the times that all series share: what a pooled model needs.
    """
    if by:
        d = number_rows(df, by, (ts,), None).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    else:
        d = number_times(df, ts, "_rn")
        d = attach(d, d.agg((F.max("_rn") + 1).alias("_n")))
    size = F.floor(F.col("_n") / (k + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("_n") - (k + 1 - F.col("fold")) * size
    role = F.when(F.col("_rn") < start, "train").when(F.col("_rn") < start + size, "test")
    return d.withColumn("role", role).filter("role is not null").drop("_rn", "_n")
