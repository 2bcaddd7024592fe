"""Forward-looking labels and lookback sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import OHLCV
from .series import Blocks, By, Frame, rolling


def add_labels(
    bars: DataFrame,
    horizon: int = 1,
    *,
    cost: float = 0.002,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """future_return_<h>d, direction (> 0) and profitable_trade (> cost); NULL where the future is not known."""
    name = f"future_return_{horizon}d"
    d = rolling(
        bars,
        lambda w: {name: F.try_divide(w.lead("close", horizon), F.col("close")) - 1},
        after=horizon,
        by=by,
        ts=ts,
        blocks=blocks,
    )
    return d.withColumns(
        {"direction": (F.col(name) > 0).cast("int"), "profitable_trade": (F.col(name) > cost).cast("int")}
    )


def label_distribution(df: DataFrame, label: str, *, by: By = ("symbol",)) -> DataFrame:
    """Count and share of every known label value; the labels are few, so only counts are shuffled."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share", F.col("n") / total)


def add_sequences(
    df: DataFrame,
    length: int,
    *,
    target: str | None = None,
    offset: int = 1,
    columns: Sequence[str] = OHLCV,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Each row with its last ``length`` rows as an array of structs (rows without a full history are dropped).

    ``target`` is read ``offset`` rows after the last step (0: the same row, for labels that already look
    ahead); the row's other columns are the features at the last step.
    """
    columns = [c for c in columns if c in df.columns]

    def step(w: Frame):
        out = {"seq": F.collect_list(F.struct(*columns)).over(w.back(length))}
        if target is not None:
            out["target"] = F.col(target) if offset == 0 else w.lead(target, offset)
        return out

    d = rolling(df, step, before=length - 1, after=offset if target else 0, by=by, ts=ts, blocks=blocks)
    d = d.filter(F.size("seq") == length)
    return d if target is None else d.filter(F.col("target").isNotNull())


def next_step_sequences(df: DataFrame, length: int, target: str = "close", columns: Sequence[str] = OHLCV, **kw) -> DataFrame:
    return add_sequences(df, length, target=target, offset=1, columns=columns, **kw)


def multiscale_sequences(df: DataFrame, lengths: Sequence[int] = (14, 60, 180), **kw) -> DataFrame:
    """One array per length; the shorter ones are tails of the longest, so the window runs once."""
    longest = max(lengths)
    d = add_sequences(df, longest, **kw)
    return d.select(
        *[c for c in d.columns if c != "seq"], *[F.slice("seq", longest - n + 1, n).alias(f"seq_{n}") for n in lengths]
    )


def flatten_sequence(df: DataFrame, seq: str = "seq", out: str = "x") -> DataFrame:
    """Array of structs -> one flat array of doubles, step by step."""
    fields = df.schema[seq].dataType.elementType.fieldNames()
    flat = F.flatten(F.transform(seq, lambda e: F.array(*[e[f].cast("double") for f in fields])))
    return df.withColumn(out, flat)
