"""Flagship: ticks -> bars -> features -> prediction -> signal -> position -> equity -> metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import sharpe
from ..operators import indicators, ledger, metrics, signals
from .fixtures import flag_bars, supp_bars


def strategy(bars: DataFrame, *, capital: float = 10_000.0) -> DataFrame:
    """Equity of a momentum strategy with its features. One exchange by series; every window runs behind it."""
    d = indicators.add_features(bars, "returns", "volatility", "sma")
    d = signals.sign_signal(signals.momentum_prediction(d, 5))
    return ledger.equity_curve(ledger.positions(d), capital=capital, fraction=0.95, commission=0.001)


def performance(equity: DataFrame, *, ppy: int = 252, rf: float = 0.02) -> DataFrame:
    """One more window pass for the peaks, then one aggregate."""
    return metrics.drawdown_series(equity).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.ln(F.max_by("equity", "ts") / F.min_by("equity", "ts")).alias("log_return"),
        F.count("side").alias("trades"),
        F.avg("volatility_20d").alias("mean_volatility"),
        sharpe(F.avg("ret"), F.stddev_samp("ret"), ppy, rf).alias("sharpe_ratio"),
        F.min("drawdown").alias("max_drawdown"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance(strategy(flag_bars(spark, sf_dir)))


def flagship_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performance(strategy(supp_bars(spark, sf_dir)))
