"""Feature frame finishing, importance and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import attach
from ..schema import OHLCV, finite_columns, numeric_columns
from ..session import cut
from . import market
from .folds import add_psar
from .indicators import FEATURES, RECURSIVE, add_cumulative, add_recursive, merge
from .moments import pair_moments
from .series import By, rolling

SENTIMENT = ("advance_decline", "momentum_sentiment")
MARKET = (
    "price_ratios", "bar_shape", "price_ma_distance", "returns", "log_return", "cum_returns", "return_stats",
    "return_shape", "volatility", "parkinson", "garman_klass", "vol_weighted",
)


def feature_frame(
    bars: DataFrame,
    kinds: Sequence[str] = ("technical", "market", "sentiment"),
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    stored: bool = True,
    psar: bool = True,
) -> DataFrame:
    """All feature columns. The window features of all kinds share one sort and one pass per level.

    The recurrences read their input on both sides of a carry join; ``stored`` writes the bars once
    before that.
    """
    unknown = set(kinds) - {"technical", "market", "sentiment"}
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    store = cut if stored else (lambda x: x)
    d = bars
    recursive: list[str] = []
    if "technical" in kinds:
        if psar:
            d = add_psar(d, by=by, ts=ts)
        recursive += [*RECURSIVE, "kama"]
    helpers = [c for c in ("rsi_14", "ema_13") if "sentiment" in kinds and c not in recursive]
    recursive += helpers
    d = store(d)
    if recursive:
        d = add_recursive(d, recursive, by=by, ts=ts, stored=stored)
    if "technical" in kinds:
        d = add_cumulative(d, by=by, ts=ts)
    if "sentiment" in kinds:
        d = market.add_bull_bear_power(market.add_fear_greed(d, by=by, ts=ts), by=by, ts=ts).drop(*helpers)
    d = store(d)
    groups = []
    if "technical" in kinds:
        groups += [n for n in FEATURES if n not in MARKET and n not in SENTIMENT]
    if "market" in kinds:
        groups += MARKET
        d = market.add_calendar(d, ts=ts)
    if "sentiment" in kinds:
        groups += SENTIMENT
    steps, before = merge([FEATURES[n] for n in groups])
    return finite_columns(rolling(d, *steps, before=before, by=by, ts=ts))


def dense_columns(df: DataFrame, min_share: float = 0.5) -> list[str]:
    """Columns with at least this share of non-NULL rows (one aggregate; one row reaches the driver)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] >= row["_n"] * min_share]


def drop_sparse(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    return df.select(*dense_columns(df, min_share))


def non_null_share(df: DataFrame) -> DataFrame:
    """(column, share of non-NULL rows) as a table."""
    one = df.agg(*[(F.count(F.col(c)) / F.count(F.lit(1))).alias(c) for c in df.columns])
    return one.select(F.expr("stack({}, {}) as (column, share)".format(len(df.columns), ", ".join(f"'{c}', `{c}`" for c in df.columns))))


def _unpivot(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        list(keys), list(features), "feature", "x"
    )


def importance_correlation(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """|Pearson correlation| with the target over rows where both are known. One pass, one row."""
    y = F.col(target).cast("double")
    one = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), y)).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "importance")


def importance_mutual_information(df: DataFrame, target: str, features: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins, in nats.

    Bins come from the column ranges (one aggregate); after that only joint counts are shuffled.
    """
    cols = [*features, target]
    limits = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    d = attach(df, limits)

    def binned(c: str):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        part = F.try_divide(F.col(c).cast("double") - lo, (hi - lo).cast("double"))
        return F.when(F.col(c).isNotNull(), F.least(F.coalesce(F.floor(part * bins), F.lit(0)), F.lit(bins - 1)).cast("int"))

    b = d.select(*[binned(c).alias(c) for c in cols])
    joint = (
        b.unpivot([target], list(features), "feature", "x")
        .filter(F.col("x").isNotNull() & F.col(target).isNotNull())
        .groupBy("feature", "x", F.col(target).alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # at most features x bins x bins rows from here on
    nx = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    j = joint.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(n, ["feature"])
    p = F.col("n") / F.col("total")
    term = p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("importance"))


def importance(df: DataFrame, target: str, features: Sequence[str], method: str = "correlation") -> DataFrame:
    if method == "correlation":
        return importance_correlation(df, target, features)
    if method == "mutual_info":
        return importance_mutual_information(df, target, features)
    raise ValueError(f"unknown method {method}")


def top_features(ranked: DataFrame, n: int = 50) -> DataFrame:
    """The n most important features (ties by name)."""
    return ranked.filter("importance is not null").orderBy(F.desc("importance"), "feature").limit(n)


def correlation_matrix(df: DataFrame, features: Sequence[str], *, by: By = ()) -> DataFrame:
    """(by, i, a, j, b, n, r) for all column pairs i < j: absolute Pearson correlation over the ``n`` rows that have both.

    One pass: the tasks sum products with matrix operations, so neither the plan nor the shuffle grows with the square of the columns
    times the rows. A constant column has no correlation.
    """
    d = pair_moments(df, features, by=by)
    names = F.array(*[F.lit(c) for c in features])
    return d.select(*by, "i", names[F.col("i")].alias("a"), "j", names[F.col("j")].alias("b"), "n", F.abs("r").alias("r"))


def correlated_features(matrix: DataFrame, threshold: float = 0.95, *, by: By = ()) -> DataFrame:
    """Features to remove: those with an earlier column correlated above the threshold, with the first such column."""
    hit = matrix.filter(F.col("r") > threshold)
    return hit.groupBy(*by, F.col("b").alias("feature")).agg(
        F.min_by("a", "i").alias("correlated_with"), F.min_by("r", "i").alias("correlation"), F.count(F.lit(1)).alias("n")
    )


def mean_correlation(matrix: DataFrame, *, by: By = ()) -> DataFrame:
    """Mean |r| of every feature with all others."""
    both = matrix.select(*by, F.col("a").alias("feature"), "r").unionByName(matrix.select(*by, F.col("b").alias("feature"), "r"))
    return both.groupBy(*by, "feature").agg(F.avg("r").alias("mean_abs_corr"))


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return numeric_columns(df, exclude=("symbol", "ts", *OHLCV, *exclude))
