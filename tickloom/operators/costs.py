"""Transaction costs, break-even and standard evaluation of 0/1 signals per model (long tables)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import div
from .series import Blocks, By, rolling

COST_LEVELS = (0.0005, 0.001, 0.002, 0.005, 0.01)
PPY = 252


def unpivot_predictions(df: DataFrame, keys: Sequence[str] = ("symbol", "ts"), prefix: str = "pred_", keep: Sequence[str] = ("ret",)) -> DataFrame:
    """``pred_<model>`` columns -> rows (model, signal)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    d = df.select(*keys, *keep, *[F.col(c).cast("int").alias(c.removeprefix(prefix)) for c in cols])
    return d.unpivot([*keys, *keep], [c.removeprefix(prefix) for c in cols], "model", "signal")


def paid_bars(
    df: DataFrame,
    *,
    rule: str = "once",
    by: By = ("model", "symbol"),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Adds ``held`` (bars with a position), ``n_paid`` (cost units due on the bar) and ``turn`` (position change).

    ``once``: a held bar pays one unit when it opens the position (except on the very first bar) or else when
    it is the last before the exit, so a one-bar position pays once. ``both_sides``: every entry and every exit
    pays one unit.
    """
    d = rolling(
        df,
        lambda w: {"pv_": w.lag("signal"), "nx_": w.lead("signal")},
        before=1,
        after=1,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    held = F.col("signal") == 1
    opens, closes = F.coalesce(F.col("pv_") == 0, F.lit(False)), F.coalesce(F.col("nx_") == 0, F.lit(False))
    if rule == "once":
        paid = (held & (opens | closes)).cast("int")
    elif rule == "both_sides":
        first, last = F.col("pv_").isNull(), F.col("nx_").isNull()
        paid = F.when(held, (opens | first).cast("int") + (closes | last).cast("int")).otherwise(0)
    else:
        raise ValueError(f"unknown rule {rule}")
    return d.withColumns(
        {"held": held, "n_paid": paid, "turn": F.abs(F.col("signal") - F.coalesce("pv_", F.lit(0))).cast("long")}
    ).drop("pv_", "nx_")


def _net(cost: Column | float, ret: str) -> Column:
    return F.when(F.col("held"), F.col(ret) - F.col("n_paid") * cost).otherwise(0.0)


def _run(x: Column, cost: Column, ppy: int) -> list[Column]:
    std = F.stddev_pop(x)
    trades = F.sum("turn")
    return [
        F.sum(x).alias("total_return"),
        (F.sum("n_paid") * F.max(cost)).alias("transaction_costs"),
        trades.alias("num_trades"),
        F.when(std > 0, math.sqrt(ppy) * F.avg(x) / F.nullif(std, F.lit(0.0))).otherwise(0.0).alias("sharpe_ratio"),
        F.coalesce(div(F.count_if(x > 0).cast("double"), F.count_if(x != 0)), F.lit(0.0)).alias("win_rate"),
        (F.sum(x) > 0).alias("profitable"),
        F.coalesce(div(F.sum(x), trades), F.lit(0.0)).alias("return_per_trade"),
        F.coalesce(F.avg(F.when(x != 0, x)), F.lit(0.0)).alias("avg_return_per_trade"),
    ]


def cost_grid(
    paid: DataFrame, levels: Sequence[float] = COST_LEVELS, *, ret: str = "ret", by: By = ("model",), ppy: int = PPY
) -> DataFrame:
    """Metrics of every model at every cost level.

    The rows are multiplied by the handful of levels inside the task that reads them (no join, no shuffle) and
    combined before the shuffle.
    """
    d = paid.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in levels])))
    return d.groupBy(*by, "cost").agg(*_run(_net(F.col("cost"), ret), F.col("cost"), ppy))


def breakeven(paid: DataFrame, *, ret: str = "ret", by: By = ("model",), max_cost: float = 0.02) -> DataFrame:
    """Cost at which the total return is 0: the total is linear in the cost. Limited to [0, max_cost]."""
    base = F.sum(F.when(F.col("held"), F.col(ret)).otherwise(0.0))
    free = F.when(base > 0, max_cost).otherwise(0.0)
    cost = F.coalesce(div(base, F.sum("n_paid")), free)
    return paid.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(max_cost), cost)).alias("breakeven_cost"))


def cost_summary(grid: DataFrame, *, by: By = ("model",)) -> DataFrame:
    """Return at the lowest and highest cost, and what the cost takes away."""
    at = lambda f, c: f(c, "cost")
    d = grid.groupBy(*by).agg(
        at(F.min_by, "total_return").alias("low_cost_return"),
        at(F.max_by, "total_return").alias("high_cost_return"),
        at(F.min_by, "profitable").alias("profitable_at_low"),
        at(F.max_by, "profitable").alias("profitable_at_high"),
        at(F.min_by, "num_trades").alias("num_trades"),
    )
    loss = F.col("low_cost_return") - F.col("high_cost_return")
    return d.withColumns(
        {
            "degradation": loss,
            "degradation_pct": F.coalesce(div(loss, F.abs("low_cost_return")) * 100.0, F.lit(0.0)),
        }
    )


def in_period(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows between the dates, both included; reaches the Parquet scan as a filter."""
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def buy_hold_return(
    bars: DataFrame,
    start: str | None = None,
    end: str | None = None,
    *,
    cost: float = 0.002,
    by: By = ("symbol",),
    ts: str = "ts",
) -> DataFrame:
    """Return of buying the first and selling the last bar of the period, both at a cost; 0 below two bars."""
    d = in_period(bars, start, end, ts).groupBy(*by).agg(
        (div(F.max_by("close", ts), F.min_by("close", ts)) - 1.0 - 2.0 * cost).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    return d.select(*by, F.when(F.col("_n") < 2, 0.0).otherwise(F.col("_r")).alias("buy_hold_return"))


def evaluate_models(
    df: DataFrame,
    baseline: DataFrame,
    *,
    cost: float = 0.002,
    start: str | None = None,
    end: str | None = None,
    ret: str = "ret",
    by: By = ("model",),
    group: By = ("symbol",),
    ts: str = "ts",
    ppy: int = PPY,
) -> DataFrame:
    """Every model over the same period, with its excess over buy and hold."""
    paid = paid_bars(in_period(df, start, end, ts), by=(*by, *group), ts=ts)
    d = paid.groupBy(*by, *group).agg(*_run(_net(cost, ret), F.lit(cost), ppy), F.count(F.lit(1)).alias("num_days"))
    d = d.join(baseline, [*group])
    excess = F.col("total_return") - F.col("buy_hold_return")
    return d.withColumns(
        {
            "excess_return": excess,
            "excess_return_pct": F.coalesce(div(excess, F.abs("buy_hold_return")) * 100.0, F.lit(0.0)),
        }
    )


def comparison_table(evaluated: DataFrame, *, group: By = ("symbol",), baseline_name: str = "Buy & Hold") -> DataFrame:
    """Models and the baseline row of each group, best total return first (rank within the group)."""
    keep = ["model", *group]
    rows = evaluated.select(
        *keep,
        (F.col("total_return") * 100.0).alias("total_return_pct"),
        (F.col("excess_return") * 100.0).alias("excess_return_pct"),
        "sharpe_ratio",
        (F.col("win_rate") * 100.0).alias("win_rate_pct"),
        F.col("num_trades").cast("long").alias("num_trades"),
        (F.col("avg_return_per_trade") * 100.0).alias("avg_return_per_trade_pct"),
    )
    base = evaluated.groupBy(*group).agg(F.max("buy_hold_return").alias("_b"))
    base = base.select(
        F.lit(baseline_name).alias("model"),
        *group,
        (F.col("_b") * 100.0).alias("total_return_pct"),
        F.lit(0.0).alias("excess_return_pct"),
        F.lit(0.0).alias("sharpe_ratio"),
        F.lit(100.0).alias("win_rate_pct"),
        F.lit(2).cast("long").alias("num_trades"),
        (F.col("_b") * 50.0).alias("avg_return_per_trade_pct"),
    )
    # one row per model and group: small
    w = Window.partitionBy(*group).orderBy(F.desc("total_return_pct"), "model")
    return rows.unionByName(base).withColumn("rank", F.row_number().over(w))
