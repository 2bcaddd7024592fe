"""Ticks to bars, bar resampling and bar look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.series import By
from ..schema import OHLCV, require


def ticks_to_bars(
    ticks: DataFrame,
    *,
    by: By = ("symbol",),
    interval: str = "1 day",
    ts: str = "ts",
    price: str = "price",
    size: str = "size",
    order: Sequence[str] | None = None,
) -> DataFrame:
    """OHLCV bars on a fixed time grid.

    ``order`` breaks ties inside a bar (default: ``ts``). One aggregate with map-side combine, so the
    shuffle carries one row per (task, series, bar) and a series with most of the ticks is no hotter
    than any other.
    """
    require(ticks, *by, ts, price, size)
    if order is None:
        order = (ts,)
    # one column keeps the aggregation buffers fixed-width (hash aggregate, no sort of the ticks)
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    slots = ticks.select(
        *by,
        F.window(ts, interval)["start"].alias("_start"),
        F.col(price).alias("_p"),
        F.col(size).alias("_q"),
        rank.alias("_k"),
    )
    return (
        slots.groupBy(*by, "_start")
        .agg(
            F.min_by("_p", "_k").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_k").alias("close"),
            F.sum("_q").alias("volume"),
        )
        .select(*by, F.col("_start").alias("ts"), *OHLCV)
    )


def pack_order(*parts: tuple[str, int]) -> Column:
    """Pack integer columns (name, decimal digits) into one decimal that sorts like the tuple.

    Decimals are fixed-width aggregation buffers, so min_by / max_by stay in a hash aggregate where a
    struct would force a sort of all ticks. Widths must hold the values: 38 digits in all.
    """
    total = sum(d for _, d in parts)
    if total > 38:
        raise ValueError("more than 38 digits")
    out, left = F.lit("0").cast("decimal(1,0)"), total
    for name, digits in parts:
        left -= digits
        part = F.col(name).cast(f"decimal({digits},0)")
        out = out + part * F.lit(str(10**left)).cast(f"decimal({left + 1},0)")
    return out.cast(f"decimal({total},0)")


def resample(bars: DataFrame, interval: str, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Coarser bars from finer ones."""
    slots = bars.withColumn("_start", F.window(ts, interval)["start"])
    return (
        slots.groupBy(*by, "_start")
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*by, F.col("_start").alias("ts"), *OHLCV)
    )


def last_bars(bars: DataFrame, n: int, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """The newest n bars of every series (the window limit is pushed below the shuffle)."""
    w = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    return bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def latest(df: DataFrame, *, by: By = ("symbol", "source"), ts: str = "ts") -> DataFrame:
    """Newest row per key, by aggregation (no sort, combines before the shuffle)."""
    rest = [c for c in df.columns if c not in (*by, ts)]
    agg = df.groupBy(*by).agg(F.max(ts).alias(ts), F.max_by(F.struct(*rest), ts).alias("_s"))
    return agg.select(*by, ts, "_s.*")


def from_epoch_millis(df: DataFrame, column: str, out: str = "ts") -> DataFrame:
    return df.withColumn(out, F.timestamp_millis(F.col(column)))


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included."""
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day"))


def spine_of(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Every day between the first and last row of ``df``."""
    span = df.agg(F.min(ts).cast("date").alias("a"), F.max(ts).cast("date").alias("b"))
    return span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))


def map_symbol(symbol: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Look up an upper-cased symbol in a small mapping; unknown ones take the default (their own name, lower case)."""
    up = F.upper(symbol)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, up), F.lower(symbol) if default is None else default)
