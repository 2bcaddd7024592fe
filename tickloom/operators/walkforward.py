"""Walk-forward windows over the row positions of each series, per-window runs and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import MAX_LOG, div, share
from .scale import fit_scaler, scale
from .series import Blocks, By, number_rows


def windows(
    df: DataFrame,
    train: int,
    test: int,
    step: int,
    *,
    expanding: bool = True,
    min_train: int = 0,
    strict: bool = False,
    by: By = ("symbol",),
) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end) as half-open row ranges, per series.

    Test ranges start at train, train + step, ... as long as they fit; ``strict`` demands that they end before
    the last row. Only the row count of each series is needed, so the table is small.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    last = F.col("_n") - test - (1 if strict else 0)
    starts = F.when(last >= train, F.sequence(F.lit(train).cast("long"), last, F.lit(step).cast("long")))
    d = n.select(*by, F.posexplode(starts).alias("window_id", "test_start"))
    return d.select(
        *by,
        "window_id",
        (F.lit(0) if expanding else F.col("test_start") - train).cast("long").alias("train_start"),
        F.col("test_start").alias("train_end"),
        "test_start",
        (F.col("test_start") + test).alias("test_end"),
    ).filter(F.col("train_end") - F.col("train_start") >= min_train)


def assign_windows(
    df: DataFrame,
    train: int,
    test: int,
    step: int,
    *,
    expanding: bool = True,
    strict: bool = False,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Each row once per window that trains on it or tests it: adds window_id and role.

    The windows of a row follow from its position by arithmetic, so there is no range join.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    d = number_rows(df, by, (ts,), blocks).join(n, [*by])
    rn = F.col("_rn")
    last = F.floor((F.col("_n") - test - (1 if strict else 0) - train) / step)  # id of the last window
    # the window whose test range starts at or before the row; earlier ids may still test it
    newest = last if expanding else F.least(last, F.floor(rn / step))
    oldest = F.greatest(F.lit(0), F.floor((rn - train - test) / step) + 1)
    ids = F.when((last >= 0) & (oldest <= newest), F.sequence(oldest.cast("long"), newest.cast("long")))
    d = d.withColumn("window_id", F.explode(ids)).withColumn("window_id", F.col("window_id").cast("int"))
    start = F.lit(train) + F.col("window_id") * step
    begin = F.lit(0) if expanding else start - train
    role = F.when((rn >= start) & (rn < start + test), "test").when((rn >= begin) & (rn < start), "train")
    return d.withColumn("role", role).filter("role is not null").drop("_rn", "_n")


def window_scaling(assigned: DataFrame, columns: Sequence[str], *, by: By = ("symbol",)) -> DataFrame:
    """Standard scaling of every window with the mean and deviation of its training rows."""
    params = fit_scaler(assigned.filter(F.col("role") == "train"), columns, "standard", by=(*by, "window_id"))
    return scale(assigned, params, columns, by=(*by, "window_id"))


def window_baseline(assigned: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Buy and hold over the test rows of each window."""
    t = assigned.filter(F.col("role") == "test")
    w = Window.partitionBy(*by, "window_id").orderBy(ts)
    t = t.withColumn("_r", div(F.col("close"), F.lag("close").over(w)) - 1.0)
    return t.groupBy(*by, "window_id").agg(
        (div(F.max_by("close", ts), F.min_by("close", ts)) - 1.0).alias("total_return"),
        F.coalesce(div(F.avg("_r"), F.stddev_samp("_r")) * (252**0.5), F.lit(0.0)).alias("sharpe_ratio"),
        share(F.col("_r") > 0).alias("win_rate"),
    )


def aggregate_windows(results: DataFrame, *, by: Sequence[str] = ("model",)) -> DataFrame:
    """Over the windows of each model: mean, population deviation, median, compounded return and counts.

    Returns compound as a sum of logarithms, ``compound_log_return``, which stays finite over any number of windows and is NULL if a
    window lost all. ``compound_return`` is -1 then, and NULL where it is beyond the range of a double.
    """
    r = F.col("total_return")
    lost = F.count_if(r <= -1) > 0
    logs = F.when(~lost, F.sum(F.when(r > -1, F.log1p(r))))
    extra = [F.avg(c).alias(f"mean_{c}") for c in ("sharpe_ratio", "accuracy", "f1_score") if c in results.columns]
    return results.groupBy(*by).agg(
        F.avg(r).alias("mean_return"),
        F.stddev_pop(r).alias("std_return"),
        F.percentile(r, 0.5).alias("median_return"),
        F.when(lost, -1.0).when(logs < MAX_LOG, F.expm1(logs)).alias("compound_return"),
        logs.alias("compound_log_return"),
        F.count_if(r > 0).alias("positive_windows"),
        F.count_if(r < 0).alias("negative_windows"),
        F.count(r).alias("total_windows"),
        *extra,
    )


def stability(results: DataFrame, metrics: Sequence[str], *, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and deviation of each metric over the windows, as rows (metric, mean, std, n)."""
    d = results.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*by], list(metrics), "metric", "_v")
    return d.groupBy(*by, "metric").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.count("_v").alias("n"))


def horizon_report(aggregated: DataFrame, *, by: By = ()) -> DataFrame:
    """Horizon (as a number) ascending, compounded return descending, in percent; for each of ``by`` if given.

    Ordered by the logarithm, which is known where the return itself is out of range; a model that lost all comes last.
    """
    d = aggregated.select(
        *by,
        F.col("horizon").cast("int").alias("horizon"),
        "model",
        *[(F.col(c) * 100.0).alias(f"{c}_pct") for c in ("mean_return", "compound_return", "std_return", "median_return")],
        "compound_log_return",
        *[c for c in ("mean_sharpe_ratio", "positive_windows", "negative_windows", "total_windows") if c in aggregated.columns],
    )
    return d.orderBy(*by, "horizon", F.col("compound_log_return").desc_nulls_last(), "model")


def best_per_horizon(aggregated: DataFrame, baseline: str = "buy_hold", *, by: By = ()) -> DataFrame:
    """Best model of each horizon by the logarithm of its return, and its gap to the baseline: in returns, and in logarithms."""
    model = F.col("model") != baseline
    best = aggregated.groupBy(*by, "horizon").agg(
        F.max(F.when(model, F.struct("compound_log_return", "model", "compound_return"))).alias("_b"),
        F.max(F.when(~model, F.struct("compound_log_return", "compound_return"))).alias("_h"),
    )
    return best.select(
        *by,
        F.col("horizon").cast("int").alias("horizon"),
        F.col("_b.model").alias("model"),
        F.col("_b.compound_return").alias("compound_return"),
        F.col("_h.compound_return").alias("baseline_return"),
        (F.col("_b.compound_return") - F.col("_h.compound_return")).alias("gap"),
        F.col("_b.compound_log_return").alias("compound_log_return"),
        F.col("_h.compound_log_return").alias("baseline_log_return"),
        (F.col("_b.compound_log_return") - F.col("_h.compound_log_return")).alias("log_gap"),
    )
