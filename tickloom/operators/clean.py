"""Cleaning of OHLCV bars. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import OHLCV, require
from .quantiles import exact_quantiles
from .series import Blocks, By, Frame, running

PRICES = OHLCV[:4]


def dedup(df: DataFrame, *, by: By = ("symbol",), ts: str = "ts", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per (series, time): the first by ``tiebreak``. An aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in (*by, ts)]
    first = F.struct(*tiebreak, *[c for c in rest if c not in tiebreak])
    out = df.groupBy(*by, ts).agg(F.min(first).alias("_f"))
    return out.select(*by, ts, *[F.col(f"_f.{c}").alias(c) for c in rest])


def repair_prices(df: DataFrame) -> DataFrame:
    """High and low cover open and close; rows with a price <= 0 go; negative volume becomes 0."""
    o, h, l, c = (F.col(x) for x in PRICES)
    fixed = df.withColumns(
        {
            "high": F.when(h < F.greatest(o, c), F.greatest(o, c)).otherwise(h),
            "low": F.when(l > F.least(o, c), F.least(o, c)).otherwise(l),
        }
    )
    positive = F.coalesce(F.least(*PRICES) > 0, F.lit(True))
    return fixed.filter(positive).withColumn("volume", F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))


def missing_count(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    return df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
        sum((F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull())).alias("total"),
    )


def fill_forward(
    df: DataFrame,
    columns: Sequence[str] = OHLCV,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    backfill: bool = True,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Last known value; ``backfill`` also fills the head of a series from its first known value (reads the future)."""
    d = running(df, {f"_f_{c}": ("last", F.col(c)) for c in columns}, by=by, ts=ts, blocks=blocks)
    filled = {c: F.col(f"_f_{c}") for c in columns}
    if backfill:
        # only the head is still NULL, and its next known value is the first one of the series
        if blocks is None:
            whole = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            heads = {c: F.first(c, ignorenulls=True).over(whole) for c in columns}
            d = d.select("*", *[x.alias(f"_h_{c}") for c, x in heads.items()])
        else:
            known = lambda c: F.when(F.col(c).isNotNull(), F.col(ts))
            d = d.join(df.groupBy(*by).agg(*[F.min_by(c, known(c)).alias(f"_h_{c}") for c in columns]), [*by])
        filled = {c: F.coalesce(x, F.col(f"_h_{c}")) for c, x in filled.items()}
    return d.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, columns: Sequence[str] = OHLCV, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Linear by row position; the head stays NULL, the tail keeps the last value."""
    frame = Frame(tuple(by), (ts,))
    ahead = frame.spec.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("_i", F.row_number().over(frame.spec))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))

    d = d.select(
        "*",
        *[F.last(known(c), ignorenulls=True).over(frame.so_far).alias(f"_p_{c}") for c in columns],
        *[F.first(known(c), ignorenulls=True).over(ahead).alias(f"_n_{c}") for c in columns],
    )

    def value(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        part = F.try_divide(F.col("_i") - p["i"], n["i"] - p["i"])
        return F.coalesce(F.col(c), p["v"] + (n["v"] - p["v"]) * part, p["v"])

    return d.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] = OHLCV) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_mean(df: DataFrame, columns: Sequence[str] = OHLCV, *, by: By = ("symbol",)) -> DataFrame:
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    d = df.join(means, [*by])
    return d.select(*[F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def outliers_iqr(
    df: DataFrame,
    columns: Sequence[str] = ("open", "high", "low", "close"),
    k: float = 3.0,
    *,
    by: By = ("symbol",),
    single_pass: bool = False,
    large_groups: bool = False,
) -> DataFrame:
    """Keep rows within k interquartile ranges of the quartiles, column after column.

    Quartiles of later columns come from the survivors of earlier ones; ``single_pass`` takes all
    quartiles from the input. Bars of a series are bounded by the calendar, so quartiles are taken in a
    window; ``large_groups`` uses counting passes and joins that never hold a group in one task.
    """
    rounds = [list(columns)] if single_pass else [[c] for c in columns]
    out = df
    for cols in rounds:
        if large_groups:
            for c in cols:
                q = exact_quantiles(df if single_pass else out, c, (0.25, 0.75), by=by)
                q = q.groupBy(*by).agg(
                    F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("_lo"),
                    F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("_hi"),
                )
                out = _within_iqr(out.join(q, [*by], "left"), [(c, F.col("_lo"), F.col("_hi"))], k).select(*df.columns)
        else:
            part = Window.partitionBy(*by)
            d = out.select("*", *[F.percentile(c, [0.25, 0.75]).over(part).alias(f"_q_{c}") for c in cols])
            out = _within_iqr(d, [(c, F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]) for c in cols], k).select(*df.columns)
    return out


def _within_iqr(df: DataFrame, limits: Sequence[tuple[str, Column, Column]], k: float) -> DataFrame:
    keep = F.lit(True)
    for c, lo, hi in limits:
        x = F.col(c)
        keep = keep & F.coalesce((x >= lo - k * (hi - lo)) & (x <= hi + k * (hi - lo)), F.lit(True))
    return df.filter(keep)


def outliers_zscore(
    df: DataFrame,
    columns: Sequence[str] = ("open", "high", "low", "close"),
    k: float = 3.0,
    *,
    by: By = ("symbol",),
) -> DataFrame:
    """Keep rows with |z| <= k (sample deviation), column after column."""
    part = Window.partitionBy(*by)
    out = df
    for c in columns:
        d = out.select("*", F.avg(c).over(part).alias("_m"), F.stddev_samp(c).over(part).alias("_s"))
        z = F.abs(F.try_divide(F.col(c) - F.col("_m"), F.col("_s")))
        out = d.filter(F.coalesce(z <= k, F.lit(True))).drop("_m", "_s")
    return out


def in_range(df: DataFrame, low: float = 0.01, high: float = 1_000_000.0, columns: Sequence[str] = PRICES) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).between(low, high)
    return df.filter(keep)


def clean_bars(
    bars: DataFrame,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    tiebreak: Sequence[str] = (),
    backfill: bool = False,
    remove_outliers: bool = True,
    k: float = 3.0,
    low: float = 0.01,
    high: float = 1_000_000.0,
) -> DataFrame:
    """De-duplicate, repair, fill, drop outliers, check the range. One shuffle by series after the dedup."""
    require(bars, *by, ts, *OHLCV)
    d = dedup(bars, by=by, ts=ts, tiebreak=tiebreak)
    d = fill_forward(repair_prices(d), by=by, ts=ts, backfill=backfill)
    if remove_outliers:
        d = outliers_iqr(d, k=k, by=by)
    return in_range(d, low, high)
