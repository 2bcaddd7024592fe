"""Trading signals: 1 buy, -1 sell, 0 hold. A prediction column is the input of every rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import attach, div, share
from .series import Blocks, By, islands, rolling


def _three_way(buy: Column, sell: Column) -> Column:
    """Sell is tested first: it wins where both hold."""
    return F.when(sell, -1).when(buy, 1).otherwise(0).cast("int")


def threshold(
    df: DataFrame,
    prediction: str = "prediction",
    *,
    buy: float = 0.6,
    sell: float = -0.6,
    confidence: Column | None = None,
    min_confidence: float = 0.5,
    **_,
) -> DataFrame:
    """Buy at or above ``buy``, sell at or below ``sell``; with a confidence column, hold where it is too low."""
    p = F.col(prediction)
    signal = _three_way(p >= buy, p <= sell)
    if confidence is not None:
        signal = F.when(confidence < min_confidence, 0).otherwise(signal).cast("int")
    return df.withColumn("signal", signal)


def class_confidence(probability: str = "probability") -> Column:
    """Largest class probability of an array column."""
    return F.array_max(probability)


def volatility_adjusted(
    df: DataFrame,
    prediction: str = "prediction",
    *,
    base: float = 0.6,
    factor: float = 2.0,
    window: int = 20,
    expanding: bool = False,
    by: By = ("symbol",),
    ts: str = "ts",
    **_,
) -> DataFrame:
    """Thresholds widen when volatility is above its mean.

    The mean is over the whole series, which looks ahead; ``expanding`` uses only the past. Where the
    volatility is not known the signal is 0.
    """
    d = rolling(
        df,
        lambda w: {"_r": w.change("close")},
        lambda w: {"_v": w.roll(F.stddev_samp, "_r", window)},
        lambda w: {"adj_": 1.0 + (div(F.col("_v"), F.avg("_v").over(w.so_far if expanding else w.whole)) - 1.0) * factor},
        by=by,
        ts=ts,
    )
    p, limit = F.col(prediction), base * F.col("adj_")
    known = limit.isNotNull()
    return d.withColumn("signal", _three_way(known & (p >= limit), known & (p <= -limit))).drop("adj_")


def trend_following(
    df: DataFrame,
    prediction: str = "prediction",
    *,
    limit: float = 0.6,
    window: int = 50,
    min_distance: float = 0.02,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
    **_,
) -> DataFrame:
    """Follow the prediction only when the close is far enough on the same side of its mean."""
    d = rolling(df, lambda w: {"ma_": w.roll(F.avg, "close", window)}, before=window - 1, by=by, ts=ts, blocks=blocks)
    p, dist = F.col(prediction), div(F.col("close") - F.col("ma_"), F.col("ma_"))
    return d.withColumn("signal", _three_way((p >= limit) & (dist >= min_distance), (p <= -limit) & (dist <= -min_distance))).drop("ma_")


def mean_reversion(
    df: DataFrame,
    prediction: str = "prediction",
    *,
    limit: float = 0.6,
    window: int = 20,
    z: float = 2.0,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
    **_,
) -> DataFrame:
    """Buy predicted rises of depressed prices, sell predicted falls of stretched ones."""
    d = rolling(
        df,
        lambda w: {"m_": w.roll(F.avg, "close", window), "s_": w.roll(F.stddev_samp, "close", window)},
        before=window - 1,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    p, score = F.col(prediction), div(F.col("close") - F.col("m_"), F.col("s_"))
    return d.withColumn("signal", _three_way((p >= limit) & (score <= -z), (p <= -limit) & (score >= z))).drop("m_", "s_")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "threshold": threshold,
    "volatility_adjusted": volatility_adjusted,
    "trend_following": trend_following,
    "mean_reversion": mean_reversion,
}


def generate(df: DataFrame, strategy: str = "threshold", **params) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; have {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, **params)


def strategy_columns(
    df: DataFrame, strategies: Sequence[str], *, by: By = ("symbol",), ts: str = "ts", **params
) -> DataFrame:
    """One ``signal_<strategy>`` column per strategy, all over the same partitioning (no join)."""
    for s in strategies:
        df = generate(df, s, by=by, ts=ts, **params).withColumnRenamed("signal", f"signal_{s}")
    return df


def long_signals(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol", "ts"), name: str = "strategy") -> DataFrame:
    """signal_<strategy> columns -> rows."""
    d = df.select(*keys, *[F.col(c).cast("int").alias(c.removeprefix("signal_")) for c in columns])
    return d.unpivot(list(keys), [c.removeprefix("signal_") for c in columns], name, "signal")


def consensus(
    signals: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    limit: float = 0.5,
    by: By = ("symbol",),
    ts: str = "ts",
    name: str = "strategy",
) -> DataFrame:
    """Weighted vote over a long signal table; a strategy without a row at a slot counts as 0."""
    if weights is None:
        names = signals.select(name).distinct()
        total = names.agg(F.count(F.lit(1)).cast("double").alias("_t"))
        w = F.lit(1.0)
        d = attach(signals, total)
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        w = F.coalesce(F.try_element_at(table, F.col(name)), F.lit(0.0))
        d = signals.withColumn("_t", F.lit(float(sum(weights.values()))))
    out = d.groupBy(*by, ts).agg((F.sum(F.col("signal") * w) / F.max("_t")).alias("score"))
    return out.withColumn("signal", _three_way(F.col("score") >= limit, F.col("score") <= -limit))


def signal_quality(signals: DataFrame, *, by: By = ("symbol",)) -> DataFrame:
    s = F.col("signal")
    buys, sells = F.count_if(s > 0), F.count_if(s < 0)
    return signals.groupBy(*by).agg(
        F.count("signal").alias("total"),
        buys.alias("buys"),
        sells.alias("sells"),
        F.count_if(s == 0).alias("holds"),
        div((buys + sells).cast("double"), F.count("signal")).alias("frequency"),
        div(buys.cast("double"), sells).alias("buy_sell_ratio"),
    )


def signal_runs(signals: DataFrame, *, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None) -> DataFrame:
    """Mean length of the runs of equal signals."""
    d = islands(
        signals,
        lambda w: {"s": ~F.col("signal").eqNullSafe(w.lag("signal"))},
        by=by,
        ts=ts,
        blocks=blocks,
    )
    runs = d.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("_len"))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.avg("_len").alias("mean_duration"))


def forward_accuracy(signals: DataFrame, forward_return: str, *, by: By = ("symbol",)) -> DataFrame:
    """How often buys were followed by a rise and sells by a fall, and the mean returns after them."""
    s, r = F.col("signal"), F.col(forward_return)
    return signals.filter(r.isNotNull()).groupBy(*by).agg(
        share(F.when(s > 0, r > 0)).alias("buy_accuracy"),
        share(F.when(s < 0, r < 0)).alias("sell_accuracy"),
        F.avg(F.when(s > 0, r)).alias("buy_mean_return"),
        F.avg(F.when(s < 0, r)).alias("sell_mean_return"),
    )


def momentum_prediction(
    bars: DataFrame, n: int = 5, *, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Mean return of the last n bars as a prediction."""
    return rolling(
        bars,
        lambda w: {"_r": w.change("close")},
        lambda w: {"prediction": w.roll(F.avg, "_r", n)},
        before=n,
        by=by,
        ts=ts,
        blocks=blocks,
    )


def sign_signal(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.withColumn("signal", F.coalesce(F.signum(prediction), F.lit(0.0)).cast("int"))


def class_at(probability: Column, limit: float = 0.5) -> Column:
    return F.when(probability > limit, 1).otherwise(0)
