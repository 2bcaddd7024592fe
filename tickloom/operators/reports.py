"""Report tables: summaries, rolling statistics, drawdown episodes, trade statistics, calendar returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import div, product, share
from ..session import cut
from .metrics import PPY, all_metrics, drawdown_runs, drawdown_series
from .series import Blocks, By, rolling, running


def executive_summary(
    equity: DataFrame, benchmark: DataFrame | None = None, *, by: By = ("symbol",), ts: str = "ts", value: str = "equity"
) -> DataFrame:
    """Period, capital, key metrics; with a benchmark (by, benchmark_return) also the excess return."""
    equity = cut(equity.select(*by, ts, "ret", value))  # read by the period and by each group of metrics
    period = equity.groupBy(*by).agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.min_by(value, ts).alias("initial_capital"),
        F.max_by(value, ts).alias("final_capital"),
    )
    m = all_metrics(equity, value=value, by=by, ts=ts, stored=False).select(
        *by, "total_return", "annualized_return", F.col("annualized_volatility").alias("volatility"),
        "sharpe_ratio", "max_drawdown", "win_rate", "total_trades",
    )
    out = period.join(m, [*by])
    if benchmark is not None:
        out = out.join(benchmark, [*by], "left").withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))
    return out


def return_distribution(df: DataFrame, *, ret: str = "ret", by: By = ("symbol",)) -> DataFrame:
    r = F.col(ret)
    return df.groupBy(*by).agg(
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min(r).alias("worst"),
        F.max(r).alias("best"),
        F.count_if(r > 0).alias("positive"),
        F.count_if(r < 0).alias("negative"),
        F.count_if(r == 0).alias("zero"),
        (share(r > 0) * 100.0).alias("positive_pct"),
    )


def add_rolling_performance(
    df: DataFrame, windows: Sequence[int] = (30, 60, 90, 252), *, ret: str = "ret", ppy: int = PPY, by: By = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Rolling volatility, Sharpe (no risk-free rate) and mean return, annualised."""
    y = math.sqrt(ppy)

    def moments(w):
        return {k: c for n in windows for k, c in ((f"_m{n}", w.roll(F.avg, ret, n)), (f"_s{n}", w.roll(F.stddev_samp, ret, n)))}

    def performance(w):
        out = {}
        for n in windows:
            mean, std = F.col(f"_m{n}"), F.col(f"_s{n}")
            out |= {f"rolling_vol_{n}": std * y, f"rolling_sharpe_{n}": div(mean, std) * y, f"rolling_return_{n}": mean * ppy}
        return out

    return rolling(df, moments, performance, before=max(windows) - 1, by=by, ts=ts)


def last_rolling(df: DataFrame, windows: Sequence[int] = (30, 90), *, by: By = ("symbol",), ts: str = "ts", **kw) -> DataFrame:
    d = add_rolling_performance(df, windows, by=by, ts=ts, **kw)
    cols = [c for n in windows for c in (f"rolling_vol_{n}", f"rolling_sharpe_{n}")]
    last = d.groupBy(*by).agg(F.max_by(F.struct(*cols), ts).alias("_l"))
    return last.select(*by, "_l.*")


def tail_risk(df: DataFrame, *, ret: str = "ret", by: By = ("symbol",)) -> DataFrame:
    q = df.groupBy(*by).agg(F.percentile(ret, [0.01, 0.05, 0.95]).alias("_q"))
    q = q.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(("var_99", "var_95", "_q95"))])
    r = F.col(ret)
    tails = df.join(q, [*by]).groupBy(*by).agg(
        F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"), F.avg(F.when(r <= F.col("var_99"), r)).alias("cvar_99")
    )
    return q.join(tails, [*by]).withColumn("tail_ratio", div(F.col("_q95"), F.abs("var_95"))).drop("_q95")


def risk_report(equity: DataFrame, *, value: str = "equity", ret: str = "ret", window: int = 30, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Volatility of volatility, share of time under water, number of drawdown periods."""
    vol = rolling(equity, lambda w: {"v_": w.roll(F.stddev_samp, ret, window)}, before=window - 1, by=by, ts=ts)
    vol = vol.groupBy(*by).agg(F.stddev_samp("v_").alias("vol_of_vol"))
    runs = drawdown_runs(equity, value=value, by=by, ts=ts).groupBy(*by, "island").agg(
        F.count_if(F.col("drawdown") < 0).alias("_u"), F.count(F.lit(1)).alias("_n")
    )
    water = runs.groupBy(*by).agg(
        F.count_if(F.col("_u") > 0).alias("drawdown_periods"), (F.sum("_u") / F.sum("_n")).alias("time_underwater")
    )
    return vol.join(water, [*by])


def drawdown_episodes(equity: DataFrame, top: int | None = None, *, value: str = "equity", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Start, end, length, depth, peak, trough and recovery of every drawdown; ``top`` keeps the deepest per key."""
    d = drawdown_runs(equity, value=value, by=by, ts=ts)
    d = rolling(d, lambda w: {"next_": F.struct(w.lead(ts).alias("t"), w.lead(value).alias("v"))}, after=1, by=by, ts=ts)
    e = d.filter(F.col("drawdown") < 0).groupBy(*by, "island").agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("_end"),
        F.count(F.lit(1)).alias("duration"),
        F.max("peak").alias("peak_value"),
        F.min(value).alias("trough_value"),
        F.max_by("next_", ts).alias("_next"),
    )
    e = e.select(
        *by,
        "start",
        F.coalesce(F.col("_next.t"), F.col("_end")).alias("end"),
        "duration",
        div(F.col("peak_value") - F.col("trough_value"), F.col("peak_value")).alias("depth"),
        "peak_value",
        "trough_value",
        F.col("_next.v").alias("recovery_value"),
        F.col("_next.t").isNull().alias("ongoing"),
    )
    if top is None:
        return e
    w = Window.partitionBy(*by).orderBy(F.desc("depth"), "start")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def trade_statistics(
    trades: DataFrame, *, by: By = ("symbol",), ts: str = "ts", order: By = (), blocks: Blocks | None = None
) -> DataFrame:
    """``order`` breaks ties in time; ``blocks`` cuts accounts with very many trades."""
    d = rolling(trades, lambda w: {"prev_": w.lag(ts)}, before=1, by=by, ts=(ts, *order), blocks=blocks)
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    gap = (sec(ts) - sec("prev_")) / 3_600.0
    days = F.floor((F.max(sec(ts)) - F.min(sec(ts))) / 86_400) + 1
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("side") == "buy").alias("buy_trades"),
        F.count_if(F.col("side") == "sell").alias("sell_trades"),
        F.avg("quantity").alias("average_trade_size"),
        F.sum("value").alias("total_volume"),
        F.sum("commission").alias("total_commission"),
        F.avg(gap).alias("average_hours_between"),
        F.min(gap).alias("min_hours_between"),
        F.max(gap).alias("max_hours_between"),
        (F.count(F.lit(1)) / days).alias("trades_per_day"),
        F.avg("price").alias("average_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.stddev_samp("price").alias("std_price"),
    )


def trades_per_day(trades: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Trades per day and the volume traded up to the end of each day."""
    d = trades.groupBy(*by, F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("trades"), F.sum("value").alias("value"))
    return running(d, {"cumulative_volume": ("sum", F.col("value"))}, by=by, ts="day").drop("value")


def monthly_returns(df: DataFrame, *, ret: str = "ret", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    return df.groupBy(*by, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(
        (product(1.0 + F.col(ret)) - 1.0).alias("monthly_return")
    )


def monthly_table(monthly: DataFrame, *, by: By = ("symbol",)) -> DataFrame:
    """One row per year, one column m1..m12 per month (known columns, so no pass to find them)."""
    p = monthly.groupBy(*by, "year").pivot("month", list(range(1, 13))).agg(F.max("monthly_return"))
    return p.select(*by, "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def histogram(df: DataFrame, bins: int = 50, *, ret: str = "ret", by: By = ("symbol",)) -> DataFrame:
    """Counts of equal-width bins between the extremes of each key; the top bin includes the maximum."""
    r = F.col(ret)
    limits = df.groupBy(*by).agg(F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    d = df.filter(r.isNotNull()).join(limits, [*by])
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.least(F.coalesce(F.floor(div(r - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        d.groupBy(*by, cell.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        .select(*by, "bin", "n", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("left_edge"))
    )


def rebase(df: DataFrame, value: str, base: float = 100.0, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Value relative to the first one of its series."""
    first = df.groupBy(*by).agg(F.min_by(value, ts).alias("_f"))
    return df.join(first, [*by]).withColumn("rebased", div(F.col(value), F.col("_f")) * base).drop("_f")


def underwater(equity: DataFrame, *, value: str = "equity", by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    return drawdown_series(equity, value=value, by=by, ts=ts)
