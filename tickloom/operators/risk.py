"""Position sizing, limits, stops, portfolio risk, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import attach, div
from .metrics import PPY, RF, benchmark_metrics, ratio_metrics, risk_metrics
from .series import By, rolling, running


@dataclass(frozen=True)
class Limits:
    max_position: float = 0.1
    max_var: float = 0.05
    max_drawdown: float = 0.2
    max_concentration: float = 0.5
    stop_loss: float = 0.05
    take_profit: float = 0.1
    lookback: int = 252
    min_position: float = 10.0


def position_size(
    strength: Column,
    value: Column,
    volatility: Column,
    method: str = "volatility",
    *,
    limits: Limits = Limits(),
    fixed_amount: float = 1000.0,
    percentage: float = 0.05,
    target_volatility: float = 0.02,
    win_rate: float = 0.55,
    avg_win: float = 0.02,
    avg_loss: float = 0.015,
    kelly_safety: float = 0.25,
    max_kelly: float = 0.1,
    risk_share: float = 0.05,
) -> Column:
    """Amount to invest: at most the position limit, 0 below the smallest position."""
    if method == "fixed":
        size = fixed_amount * strength
    elif method == "percentage":
        size = value * percentage * strength
    elif method == "volatility":
        scaler = F.least(target_volatility / F.greatest(volatility, F.lit(0.001)), F.lit(10.0))
        size = value * limits.max_position * scaler * strength
    elif method == "kelly":
        odds = avg_win / avg_loss
        edge = (odds * win_rate - (1.0 - win_rate)) / odds
        size = value * F.greatest(F.least(edge * kelly_safety * strength, F.lit(max_kelly)), F.lit(0.0))
    elif method == "risk_parity":
        size = value * div(F.lit(risk_share), volatility) * strength
    else:
        raise ValueError(f"unknown method {method}")
    size = F.least(size, value * limits.max_position)
    return F.when(size < limits.min_position, 0.0).otherwise(size)


def violations(
    weight: Column, concentration: Column, var: Column, history: Column, drawdown: Column, limits: Limits = Limits()
) -> Column:
    """Names of the limits that do not hold; VaR counts only with more rows of history than the lookback."""
    return F.array_compact(
        F.array(
            F.when(weight > limits.max_position, "position_weight"),
            F.when(concentration > limits.max_concentration, "concentration"),
            F.when((history > limits.lookback) & (var > limits.max_var), "portfolio_var"),
            F.when(drawdown < -limits.max_drawdown, "drawdown"),
        )
    )


def check_limits(decisions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds violations and allowed to rows with quantity, price, value, held_value, var, history, drawdown."""
    proposed = F.col("quantity") * F.col("price")
    found = violations(
        div(proposed, F.col("value")),
        div(F.col("held_value") + proposed, F.col("value")),
        F.col("var"),
        F.col("history"),
        F.col("drawdown"),
        limits,
    )
    return decisions.withColumn("violations", found).withColumn("allowed", F.size("violations") == 0)


def stop_levels(
    entry: Column,
    long: Column,
    *,
    volatility: Column | None = None,
    atr: Column | None = None,
    limits: Limits = Limits(),
) -> tuple[Column, Column]:
    """(stop loss, take profit) prices from volatility, else ATR, else fixed distances."""
    fixed = (F.lit(limits.stop_loss), F.lit(limits.take_profit))
    stop, take = fixed
    if atr is not None:
        share = div(atr, entry)
        stop, take = F.coalesce(share * 2.0, fixed[0]), F.coalesce(share * 3.0, fixed[1])
    if volatility is not None:
        known = volatility.isNotNull()
        stop = F.when(known, F.greatest(volatility * 2.0, fixed[0])).otherwise(stop)
        take = F.when(known, F.greatest(volatility * 3.0, fixed[1])).otherwise(take)
    side = F.when(long, 1.0).otherwise(-1.0)
    return entry * (1.0 - side * stop), entry * (1.0 + side * take)


def portfolio_returns(bars: DataFrame, weights: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Weighted return per time on the dates that every weighted series has (weights: by, weight).

    The weight table has one row per series; it is joined, not broadcast by hand, so its size does not matter.
    """
    d = rolling(bars.select(*by, ts, "close"), lambda w: {"r_": w.change("close")}, before=1, by=by, ts=ts)
    d = d.filter(F.col("r_").isNotNull()).join(weights, [*by])
    n = weights.agg(F.count(F.lit(1)).alias("_m"))
    out = d.groupBy(ts).agg(F.sum(F.col("r_") * F.col("weight")).alias("ret"), F.count(F.lit(1)).alias("_c"))
    return attach(out, n).filter(F.col("_c") == F.col("_m")).select(ts, "ret")


def portfolio_risk(
    returns: DataFrame, benchmark: DataFrame | None = None, *, key: str = "portfolio", ppy: int = PPY, rf: float = RF, ts: str = "ts"
) -> DataFrame:
    """VaR, CVaR, volatility, drawdowns, Sharpe, and beta and correlation with a benchmark, per portfolio."""
    d = returns if key in returns.columns else returns.withColumn(key, F.lit("all"))
    by = (key,)
    risk = risk_metrics(d, by=by, ppy=ppy).select(
        key,
        F.abs("var_95").alias("portfolio_var"),
        F.abs("cvar_95").alias("portfolio_cvar"),
        F.col("annualized_volatility").alias("volatility"),
    )
    dd = compounded_drawdown(d, by=by, ts=ts).groupBy(key).agg(
        F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", ts).alias("current_drawdown")
    )
    out = risk.join(dd, [key]).join(ratio_metrics(d, by=by, ppy=ppy, rf=rf).select(key, "sharpe_ratio"), [key])
    if benchmark is not None:
        b = benchmark_metrics(d, benchmark, by=by, ppy=ppy, rf=rf, ts=ts).select(key, "beta", "correlation")
        out = out.join(b, [key], "left")
    return out


def compounded_drawdown(returns: DataFrame, *, ret: str = "ret", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Drawdown of the compounded value, on a log scale so that long histories neither overflow nor vanish.

    A loss of everything counts as a very large negative step, after which the drawdown stays at -1.
    """
    step = F.when(F.col(ret) > -1, F.log1p(ret)).otherwise(-1e6)
    d = running(returns, {"log_value": ("sum", step)}, by=by, ts=ts)
    d = running(d, {"_peak": ("max", F.col("log_value"))}, by=by, ts=ts)
    return d.withColumn("drawdown", F.exp(F.col("log_value") - F.col("_peak")) - 1.0).drop("_peak")


def alerts(risk: DataFrame, limits: Limits = Limits(), *, concentration: float = 0.4, volatility: float = 0.4, near: float = 0.8) -> DataFrame:
    """One row per alert: at 80 % of the VaR and drawdown limits, high concentration or volatility, negative Sharpe."""
    found = F.array_compact(
        F.array(
            F.when(F.col("portfolio_var") > limits.max_var * near, "var"),
            F.when(F.col("current_drawdown") < -limits.max_drawdown * near, "drawdown"),
            F.when(F.col("risky_weight") > concentration, "concentration"),
            F.when(F.col("volatility") > volatility, "volatility"),
            F.when(F.col("sharpe_ratio") < 0, "sharpe"),
        )
    )
    return risk.withColumn("alert", F.explode(found))


def risk_level(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the utilisation of the limits, a weighted risk score and its level."""
    s = F.col("sharpe_ratio")
    var_use = F.col("portfolio_var") / limits.max_var
    dd_use = F.abs("current_drawdown") / limits.max_drawdown
    score = (
        0.3 * var_use
        + 0.3 * dd_use
        + 0.2 * F.least(F.col("volatility") / 0.3, F.lit(1.0))
        + 0.2 * F.when(s > 0, F.greatest(F.lit(0.0), (2.0 - s) / 2.0)).otherwise(1.0)
    )
    level = (
        F.when(F.col("risk_score") < 0.3, "LOW")
        .when(F.col("risk_score") < 0.6, "MEDIUM")
        .when(F.col("risk_score") < 0.8, "HIGH")
        .otherwise("CRITICAL")
    )
    return df.withColumns({"var_utilisation": var_use, "drawdown_utilisation": dd_use, "risk_score": score}).withColumn("risk_level", level)


def emergency(drawdown: Column, var: Column, limits: Limits = Limits()) -> Column:
    """Reason to stop (NULL: none): drawdown 20 % beyond its limit, VaR twice its limit."""
    return F.when(drawdown < -1.2 * limits.max_drawdown, "drawdown").when(var > 2.0 * limits.max_var, "var")
