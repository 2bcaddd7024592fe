"""Performance metrics of returns and equity, one row per key.

First-order metrics are one aggregate; those that need a mean or a quantile first join the (small) first
result back. Peaks and streaks are running operators.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div, kurt_corrected, log_product, product, share, sharpe, skew_corrected
from ..session import cut
from .series import Blocks, By, islands, rolling, running

PPY, RF = 252, 0.02


def _counted(f, correct, x: str) -> Column:
    n = F.count(x).cast("double")
    v = f(x)
    return correct(F.when(~F.isnan(v), v), n)


def return_metrics(df: DataFrame, *, ret: str = "ret", ppy: int = PPY, by: By = ("symbol",)) -> DataFrame:
    """Returns compound by logarithms: ``log_return`` is known over any number of periods (NULL after a total loss), ``final_value`` and
    ``total_return`` are NULL where they are beyond the range of a double."""
    r = F.col(ret)
    return df.groupBy(*by).agg(
        (product(1.0 + r) - 1.0).alias("total_return"),
        product(1.0 + r).alias("final_value"),
        log_product(1.0 + r).alias("log_return"),
        (F.pow(1.0 + F.avg(r), F.lit(float(ppy))) - 1.0).alias("annualized_return"),
        F.avg(r).alias("mean_return"),
        F.percentile(r, 0.5).alias("median_return"),
        F.avg(r).alias("arithmetic_mean"),
        (F.exp(F.avg(F.when(r > -1, F.log1p(r)))) - 1.0).alias("geometric_mean"),
    )


def risk_metrics(df: DataFrame, *, ret: str = "ret", ppy: int = PPY, by: By = ("symbol",), approx: bool = False) -> DataFrame:
    """Volatility, downside, VaR / CVaR, moments, semi-deviation. ``approx`` trades exact quantiles for sketches."""
    r, y = F.col(ret), math.sqrt(ppy)
    # one aggregation buffer for both quantiles
    tails = F.percentile_approx(r, [0.05, 0.01], 10_000) if approx else F.percentile(r, [0.05, 0.01])
    down = F.when(r < 0, r)
    first = df.groupBy(*by).agg(
        F.stddev_samp(r).alias("volatility"),
        (F.stddev_samp(r) * y).alias("annualized_volatility"),
        (F.stddev_samp(down) * y).alias("downside_deviation"),
        (F.var_samp(down) * ppy).alias("downside_variance"),
        tails.alias("_tails"),
        _counted(F.skewness, skew_corrected, ret).alias("skewness"),
        _counted(F.kurtosis, kurt_corrected, ret).alias("kurtosis"),
        F.avg(r).alias("_mean"),
    )
    first = first.withColumns({"var_95": F.col("_tails")[0], "var_99": F.col("_tails")[1]}).drop("_tails")
    below = r - F.col("_mean")
    second = (
        df.select(*by, ret)
        .join(first.select(*by, "var_95", "var_99", "_mean"), [*by])
        .groupBy(*by)
        .agg(
            F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
            F.avg(F.when(r <= F.col("var_99"), r)).alias("cvar_99"),
            (F.sqrt(F.avg(F.when(below < 0, below * below))) * y).alias("semi_deviation"),
        )
    )
    return first.drop("_mean").join(second, [*by], "left")


def ratio_metrics(df: DataFrame, *, ret: str = "ret", ppy: int = PPY, rf: float = RF, by: By = ("symbol",)) -> DataFrame:
    """Sharpe, Sortino, Omega; Omega is NULL without losses."""
    r, t = F.col(ret), rf / ppy
    down = F.stddev_samp(F.when(r < t, r))
    return df.groupBy(*by).agg(
        sharpe(F.avg(r), F.stddev_samp(r), ppy, rf).alias("sharpe_ratio"),
        F.when(down != 0, (F.avg(r) - t) / F.nullif(down, F.lit(0.0)) * math.sqrt(ppy)).otherwise(0.0).alias("sortino_ratio"),
        div(F.sum(F.when(r > t, r - t).otherwise(0.0)), F.sum(F.when(r < t, t - r).otherwise(0.0))).alias("omega_ratio"),
    )


def drawdown_series(
    df: DataFrame, *, value: str = "equity", by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Adds the running peak and the drawdown from it."""
    d = running(df, {"peak": ("max", F.col(value))}, by=by, ts=ts, blocks=blocks)
    return d.withColumn("drawdown", div(F.col(value) - F.col("peak"), F.col("peak")))


def drawdown_runs(
    df: DataFrame, *, value: str = "equity", by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Drawdown series plus ``island``, the number of the run of bars under (or not under) water."""
    d = drawdown_series(df, value=value, by=by, ts=ts, blocks=blocks)
    under = F.col("drawdown") < 0
    return islands(d, lambda w: {"s": ~under.eqNullSafe(w.lag(under))}, by=by, ts=ts, blocks=blocks)


def drawdown_metrics(
    df: DataFrame, *, value: str = "equity", ppy: int = PPY, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Depths, durations (open run included), recovery factor and Calmar ratio."""
    v, dd = F.col(value), F.col("drawdown")
    runs = (
        drawdown_runs(df, value=value, by=by, ts=ts, blocks=blocks)
        .groupBy(*by, "island")
        .agg(
            F.count(F.lit(1)).alias("_len"),
            F.min(dd).alias("_min"),
            F.sum(F.when(dd < 0, dd)).alias("_sum"),
            F.count_if(dd < 0).alias("_under"),
            F.min(F.struct(ts, value)).alias("_first"),
            F.max(F.struct(ts, value)).alias("_last"),
        )
    )
    d = runs.groupBy(*by).agg(
        F.min("_min").alias("max_drawdown"),
        div(F.sum("_sum"), F.sum("_under")).alias("avg_drawdown"),
        F.coalesce(F.max(F.when(F.col("_under") > 0, F.col("_len"))), F.lit(0)).alias("max_drawdown_duration"),
        F.coalesce(F.avg(F.when(F.col("_under") > 0, F.col("_len"))), F.lit(0.0)).alias("avg_drawdown_duration"),
        F.count_if(F.col("_under") > 0).alias("drawdown_periods"),
        F.sum("_len").alias("_n"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    growth = div(F.col("_last")[value], F.col("_first")[value])
    depth = F.abs("max_drawdown")
    return d.select(
        *by,
        "max_drawdown",
        "avg_drawdown",
        "max_drawdown_duration",
        "avg_drawdown_duration",
        "drawdown_periods",
        div(growth - 1.0, depth).alias("recovery_factor"),
        div(F.pow(growth, ppy / F.col("_n")) - 1.0, depth).alias("calmar_ratio"),
    )


def benchmark_metrics(
    df: DataFrame,
    benchmark: DataFrame | None = None,
    *,
    ret: str = "ret",
    bench: str = "bench",
    ppy: int = PPY,
    rf: float = RF,
    by: By = ("symbol",),
    ts: str = "ts",
) -> DataFrame:
    """Tracking error, information ratio, beta, alpha, Treynor, capture ratios and correlation.

    ``benchmark`` (ts, bench) is joined on time; pass None when ``df`` already has the column.
    """
    d = (df if benchmark is None else df.join(benchmark, [ts])).filter(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    r, b, t, y = F.col(ret), F.col(bench), rf / ppy, math.sqrt(ppy)
    active = F.stddev_samp(r - b)
    a = d.groupBy(*by).agg(
        (active * y).alias("tracking_error"),
        F.when(active != 0, F.avg(r - b) / F.nullif(active, F.lit(0.0)) * y).otherwise(0.0).alias("information_ratio"),
        F.coalesce(div(F.covar_samp(r, b), F.var_samp(b)), F.lit(0.0)).alias("beta"),
        (F.avg(r) - t).alias("_ex"),
        (F.avg(b) - t).alias("_bx"),
        div(F.avg(F.when(b > 0, r)), F.avg(F.when(b > 0, b))).alias("up_capture_ratio"),
        div(F.avg(F.when(b < 0, r)), F.avg(F.when(b < 0, b))).alias("down_capture_ratio"),
        F.corr(r, b).alias("correlation"),
    )
    return a.withColumns(
        {"alpha": (F.col("_ex") - F.col("beta") * F.col("_bx")) * ppy, "treynor_ratio": div(F.col("_ex") * ppy, F.col("beta"))}
    ).drop("_ex", "_bx")


def trading_metrics(df: DataFrame, *, ret: str = "ret", by: By = ("symbol",)) -> DataFrame:
    """Counts and sizes of winning and losing periods."""
    r = F.col(ret)
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    d = df.filter(r.isNotNull()).groupBy(*by).agg(
        F.count(r).alias("total_trades"),
        F.count(win).alias("winning_trades"),
        F.count(loss).alias("losing_trades"),
        F.count_if(r == 0).alias("zero_trades"),
        share(r > 0).alias("win_rate"),
        share(r < 0).alias("loss_rate"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        div(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.coalesce(F.max(win), F.lit(0.0)).alias("largest_win"),
        F.coalesce(F.min(loss), F.lit(0.0)).alias("largest_loss"),
    )
    expectancy = F.when(
        F.col("loss_rate") != 0, F.col("win_rate") * F.col("avg_win") + F.col("loss_rate") * F.col("avg_loss")
    ).otherwise(F.col("avg_win"))
    return d.withColumn("expectancy", expectancy)


def streak_metrics(
    df: DataFrame, *, ret: str = "ret", by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Longest and mean runs of winning and losing periods."""
    d = df.filter(F.col(ret).isNotNull()).withColumn("sign_", F.signum(ret).cast("int"))
    d = islands(d, lambda w: {"s": ~F.col("sign_").eqNullSafe(w.lag("sign_"))}, by=by, ts=ts, blocks=blocks)
    runs = d.groupBy(*by, "island").agg(F.first("sign_").alias("_s"), F.count(F.lit(1)).alias("_len"))
    wins, losses = (F.when(F.col("_s") == s, F.col("_len")) for s in (1, -1))
    return runs.groupBy(*by).agg(
        F.coalesce(F.max(wins), F.lit(0)).alias("max_consecutive_wins"),
        F.coalesce(F.max(losses), F.lit(0)).alias("max_consecutive_losses"),
        F.coalesce(F.avg(wins), F.lit(0.0)).alias("avg_consecutive_wins"),
        F.coalesce(F.avg(losses), F.lit(0.0)).alias("avg_consecutive_losses"),
    )


def value_summary(
    df: DataFrame, *, value: str = "equity", ppy: int = PPY, rf: float = RF, by: By = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Totals of a value history in percent."""
    d = rolling(drawdown_series(df, value=value, by=by, ts=ts), lambda w: {"r_": w.change(value)}, before=1, by=by, ts=ts)
    a = d.groupBy(*by).agg(
        div(F.max_by(value, ts), F.min_by(value, ts)).alias("_g"),
        F.count(F.lit(1)).alias("_n"),
        (F.stddev_samp("r_") * math.sqrt(ppy) * 100.0).alias("volatility_pct"),
        (F.min("drawdown") * 100.0).alias("max_drawdown_pct"),
        (F.max_by("drawdown", ts) * 100.0).alias("current_drawdown_pct"),
        sharpe(F.avg("r_"), F.stddev_samp("r_"), ppy, rf).alias("sharpe_ratio"),
    )
    return a.withColumns(
        {
            "total_return_pct": (F.col("_g") - 1.0) * 100.0,
            "annualized_return_pct": (F.pow(F.col("_g"), ppy / F.col("_n")) - 1.0) * 100.0,
        }
    ).drop("_g", "_n")


def all_metrics(
    df: DataFrame, *, ret: str = "ret", value: str = "equity", ppy: int = PPY, rf: float = RF, by: By = ("symbol",), ts: str = "ts", stored: bool = True
) -> DataFrame:
    """Every metric of returns and equity in one wide row per key.

    Six aggregates read the rows, so they are ``stored`` first (only the columns in use).
    """
    df = df.select(*by, ts, ret, value)
    if stored:
        df = cut(df)
    known = df.filter(F.col(ret).isNotNull())
    parts = [
        return_metrics(known, ret=ret, ppy=ppy, by=by),
        risk_metrics(known, ret=ret, ppy=ppy, by=by),
        ratio_metrics(known, ret=ret, ppy=ppy, rf=rf, by=by),
        drawdown_metrics(df, value=value, ppy=ppy, by=by, ts=ts),
        trading_metrics(known, ret=ret, by=by),
        streak_metrics(known, ret=ret, by=by, ts=ts),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [*by], "left")
    return out
