"""Ordered state machines whose next state depends on data and state in a way no window expresses.

Only the state transition is Python, over NumPy columns of one series (or one block of it).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import cut
from .series import Blocks, By, number_rows

State = list[float]
# (columns, state at entry or None at the start of the series) -> (output columns, state at exit)
Fold = Callable[[dict[str, np.ndarray], State | None], tuple[dict[str, np.ndarray], State]]


def fold(
    df: DataFrame,
    fn: Fold,
    inputs: Sequence[str],
    outputs: dict[str, T.DataType],
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Add the columns a state machine emits along each series.

    With ``blocks``, all blocks run in parallel from a guessed entry state and are run again only where
    the exit state of the block before turns out different; states that forget their past settle after a
    few rounds, and after r rounds the first r blocks of a series are right in any case, so the result
    is always exact.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in outputs.items()]])
    order, names, cols = ts, list(outputs), list(inputs)

    def run(pdf: pd.DataFrame, state: State | None) -> tuple[pd.DataFrame, State]:
        pdf = pdf.sort_values(order, kind="stable")
        out, end = fn({c: pdf[c].to_numpy() for c in cols}, state)
        return pdf.assign(**{n: out[n] for n in names}), end

    if blocks is None:
        return df.groupBy(*by).applyInPandas(lambda pdf: run(pdf, None)[0][schema.names], schema)

    keys = [*by, "_blk"]
    d = number_rows(df, by, (ts,), blocks).withColumn("_blk", F.floor(F.col("_rn") / blocks.rows).cast("long"))
    d = cut(d.drop("_rn"))
    key_fields = [d.schema[k] for k in keys]
    end_schema = T.StructType([*key_fields, T.StructField("_out", T.ArrayType(T.DoubleType()))])
    full_schema = T.StructType([*schema.fields, T.StructField("_blk", T.LongType())])

    def entry(pdf: pd.DataFrame) -> State | None:
        s = pdf["_in"].iloc[0]
        return None if s is None else [float(v) for v in s]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        _, end = run(pdf, entry(pdf))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), [float(v) for v in end]]], columns=end_schema.names)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, entry(pdf))[0][full_schema.names]

    unknown = F.lit(None).cast("array<double>")
    states = d.select(*keys).distinct().withColumn("_in", unknown)
    ends = cut(d.join(states, keys).groupBy(*keys).applyInPandas(exits, end_schema))
    while True:
        entered = ends.select(*by, (F.col("_blk") + 1).alias("_blk"), F.col("_out").alias("_next"))
        now = states.join(entered, keys, "left")
        changed = cut(now.filter(~F.col("_next").eqNullSafe(F.col("_in"))).select(*keys, F.col("_next").alias("_in")))
        states = cut(now.select(*keys, F.col("_next").alias("_in")))
        if changed.isEmpty():
            break
        again = d.join(changed, keys).groupBy(*keys).applyInPandas(exits, end_schema)
        ends = cut(ends.join(changed, keys, "left_anti").unionByName(again))
    return d.join(states, keys).groupBy(*keys).applyInPandas(rows, full_schema).drop("_blk")


def _psar(step: float, limit: float) -> Fold:
    def fn(cols, state):
        high, low, close = cols["high"], cols["low"], cols["close"]
        out = np.full(len(close), np.nan)
        # bars seen, trend (1 up, -1 down), stop, extreme, acceleration, high and low of the two bars before
        seen, trend, sar, ep, af, h1, h2, l1, l2 = state if state else (0, 1, 0, 0, step, 0, 0, 0, 0)
        for i in range(len(close)):
            h, lo = high[i], low[i]
            if np.isnan(h) or np.isnan(lo):  # a bar without prices leaves the state as it was
                continue
            if seen == 0:
                sar, ep = lo, h
            elif seen > 1:
                sar += af * (ep - sar)
                sar = min(sar, l1, l2) if trend > 0 else max(sar, h1, h2)
                if (lo < sar) if trend > 0 else (h > sar):
                    trend, sar, ep, af = -trend, ep, (lo if trend > 0 else h), step
                elif (h > ep) if trend > 0 else (lo < ep):
                    ep, af = (h if trend > 0 else lo), min(af + step, limit)
                out[i] = sar
            else:
                ep = max(ep, h)
            h2, h1, l2, l1 = h1, h, l1, lo
            seen = min(seen + 1, 2)
        return {"psar": out}, [seen, trend, sar, ep, af, h1, h2, l1, l2]

    return fn


def add_psar(
    bars: DataFrame,
    step: float = 0.02,
    limit: float = 0.2,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Parabolic stop and reverse; starts in an up trend, NULL on the first two bars."""
    d = fold(bars, _psar(step, limit), ("high", "low", "close"), {"psar": T.DoubleType()}, by=by, ts=ts, blocks=blocks)
    return d.withColumn("psar", F.when(~F.isnan("psar"), F.col("psar")))


def _stops(stop: float | None, take: float | None, slippage: float) -> Fold:
    def fn(cols, state):
        price, signal = cols["close"], cols["signal"]
        n = len(price)
        pos, reason = np.zeros(n, np.int32), np.full(n, None, object)
        entry = state[0] if state else np.nan
        for i in range(n):
            p, s = price[i], signal[i]
            if entry == entry:  # long
                if stop is not None and p <= entry * (1 - stop):
                    entry, reason[i] = np.nan, "stop"
                elif take is not None and p >= entry * (1 + take):
                    entry, reason[i] = np.nan, "take_profit"
                elif s < 0:
                    entry, reason[i] = np.nan, "signal"
            elif s > 0:
                entry = p * (1 + slippage)
            pos[i] = entry == entry
        return {"position": pos, "exit_reason": reason}, [entry]

    return fn


def positions_with_stops(
    signals: DataFrame,
    stop: float | None = 0.05,
    take: float | None = 0.10,
    slippage: float = 0.0,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Long/flat position with stop loss and take profit, tested on the close before the signal.

    Which entry a bar belongs to depends on the exits before it, hence a state machine.
    """
    out = {"position": T.IntegerType(), "exit_reason": T.StringType()}
    d = signals.withColumn("signal", F.coalesce(F.col("signal"), F.lit(0)).cast("int"))
    return fold(d, _stops(stop, take, slippage), ("close", "signal"), out, by=by, ts=ts, blocks=blocks)
