"""Combining several sources of the same bars (long table with a ``source`` column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.series import By
from ..schema import OHLCV


def source_counts(df: DataFrame, by: By = ("symbol",)) -> DataFrame:
    """Number of sources per series."""
    return df.select(*by, "source").distinct().groupBy(*by).agg(F.count("source").alias("_n"))


def common_slots(df: DataFrame, *, by: By = ("symbol",), ts: str = "ts", sources: Sequence[str] | None = None) -> DataFrame:
    """(series, time) slots that every source has; the count replaces pairwise joins."""
    if sources is not None:
        seen = df.filter(F.col("source").isin(*sources))
        return seen.groupBy(*by, ts).agg(F.countDistinct("source").alias("_c")).filter(F.col("_c") == len(sources)).drop("_c")
    seen = df.groupBy(*by, ts).agg(F.countDistinct("source").alias("_c"))
    return seen.join(source_counts(df, by), [*by]).filter(F.col("_c") == F.col("_n")).select(*by, ts)


def combine_average(
    df: DataFrame,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    sources: Sequence[str] | None = None,
    zero_volume_is_missing: bool = False,
) -> DataFrame:
    """Mean of the sources on the slots all of them have; a single source passes through."""
    volume = F.when(F.col("volume") != 0, F.col("volume")) if zero_volume_is_missing else F.col("volume")
    if sources is not None:
        df = df.filter(F.col("source").isin(*sources))
    out = df.groupBy(*by, ts).agg(
        *[F.avg(c).alias(c) for c in OHLCV[:4]],
        F.avg(volume).alias("volume"),
        F.countDistinct("source").alias("_c"),
    )
    if sources is not None:
        return out.filter(F.col("_c") == len(sources)).drop("_c")
    return out.join(source_counts(df, by), [*by]).filter(F.col("_c") == F.col("_n")).drop("_c", "_n")


def combine_priority(
    df: DataFrame,
    priority: Sequence[str],
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    per_bar: bool = False,
) -> DataFrame:
    """Take the source that comes first in ``priority`` (unlisted ones after it, by name).

    Per series: all bars come from the best source the series has. ``per_bar``: gaps of the best
    source are filled from the next one.
    """
    listed = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    rank = F.struct(F.when(listed == 0, len(priority) + 1).otherwise(listed).alias("r"), F.col("source").alias("s"))
    if per_bar:
        best = df.groupBy(*by, ts).agg(F.min(F.struct(rank.alias("k"), F.struct("source", *OHLCV).alias("v"))).alias("_m"))
        return best.select(*by, ts, "_m.v.*")
    best = df.groupBy(*by).agg(F.min(rank).alias("_k"))
    return df.join(best, [*by]).filter(F.col("source") == F.col("_k.s")).select(*by, ts, "source", *OHLCV)


def combine(df: DataFrame, method: str = "average", priority: Sequence[str] = (), **kw) -> DataFrame:
    if method == "average":
        return combine_average(df, **kw)
    if method in ("first", "priority"):
        return combine_priority(df, priority, **kw)
    raise ValueError(f"unknown method {method}")


def align(bars: DataFrame, other: DataFrame, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Rows of both tables on their common slots."""
    return bars.join(other, [*by, ts], "inner")
