"""Data-quality checks: each returns a typed table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div
from ..sources.combine import source_counts
from ..session import cut
from .series import Blocks, By, rolling


def price_jumps(
    bars: DataFrame, threshold: float = 0.10, *, by: By = ("symbol",), ts: str = "ts", blocks: Blocks | None = None
) -> DataFrame:
    """Crashes and spikes: |return| above the threshold."""
    d = rolling(bars, lambda w: {"price_before": w.lag("close"), "ret": w.change("close")}, before=1, by=by, ts=ts, blocks=blocks)
    return d.filter(F.abs("ret") > threshold).select(
        *by,
        ts,
        "price_before",
        F.col("close").alias("price_after"),
        "ret",
        F.abs("ret").alias("magnitude"),
        F.when(F.col("ret") < 0, "crash").otherwise("spike").alias("direction"),
    )


def seconds(ts: str | Column) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def gaps(
    bars: DataFrame,
    interval_seconds: int = 86_400,
    max_gap_hours: float | None = None,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Holes longer than the limit: 48 h for daily and hourly bars, else 48 intervals."""
    if max_gap_hours is None:
        max_gap_hours = 48.0 if interval_seconds in (3_600, 86_400) else 48.0 * interval_seconds / 3_600
    d = rolling(bars, lambda w: {"gap_start": w.lag(ts)}, before=1, by=by, ts=ts, blocks=blocks)
    length = seconds(ts) - seconds("gap_start")
    return d.filter(length > max_gap_hours * 3_600).select(
        *by,
        "gap_start",
        F.col(ts).alias("gap_end"),
        (length / 3_600.0).alias("gap_hours"),
        (F.floor(length / F.lit(interval_seconds)) - 1).cast("long").alias("missing_periods"),
    )


def extreme_values(bars: DataFrame, limit: float = 5.0, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """|z| above the limit in high, low or close, against the mean and deviation of the whole series."""
    cols = ("high", "low", "close")
    long = bars.select(*by, ts, *cols).unpivot([*by, ts], list(cols), "column", "value")
    stats = bars.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    stats = stats.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("m"), F.col(f"s_{c}").alias("s")) for c in cols])).alias("_s")).select(*by, "_s.*")
    z = div(F.col("value") - F.col("m"), F.col("s"))
    return (
        long.join(stats, [*by, "column"])
        .filter(F.abs(z) > limit)
        .select(*by, ts, "column", "value", F.abs(z).alias("z_score"), z.alias("std_deviation"))
    )


def volume_anomalies(
    bars: DataFrame,
    spike: float = 10.0,
    low: float = 0.01,
    window: int = 30,
    *,
    by: By = ("symbol",),
    ts: str = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Volume far above, or next to nothing of, its recent mean (which includes the bar itself)."""
    d = rolling(
        bars, lambda w: {"avg_volume": w.roll(F.avg, "volume", window, 1)}, before=window - 1, by=by, ts=ts, blocks=blocks
    )
    ratio = div(F.col("volume"), F.col("avg_volume"))
    kind = F.when(ratio > spike, "spike").when(F.col("volume") < low * F.col("avg_volume"), "low")
    return d.select(*by, ts, "volume", "avg_volume", ratio.alias("spike_ratio"), kind.alias("kind")).filter("kind is not null")


def source_divergence(bars: DataFrame, threshold: float = 0.05, *, by: By = ("symbol",), ts: str = "ts") -> DataFrame:
    """Slots all sources of a series have, where their closes differ by more than the threshold."""
    d = bars.groupBy(*by, ts).agg(
        F.max("close").alias("max_price"),
        F.min("close").alias("min_price"),
        # one entry per source, and sources are few
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "close")))).alias("sources"),
        F.countDistinct("source").alias("_c"),
    )
    d = d.join(source_counts(bars, by), [*by]).filter((F.col("_c") == F.col("_n")) & (F.col("_n") > 1))
    diff = F.col("max_price") - F.col("min_price")
    pct = div(diff, F.col("max_price"))
    return d.filter((F.col("max_price") > 0) & (pct > threshold)).select(
        *by, ts, "sources", "max_price", "min_price", pct.alias("divergence_pct"), diff.alias("divergence_amount")
    )


def freshness(
    bars: DataFrame, as_of: Column, max_age_hours: float = 48.0, *, by: By = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Age of the newest bar at ``as_of``."""
    d = bars.groupBy(*by).agg(F.max(ts).alias("latest"))
    age = (seconds(as_of) - seconds("latest")) / 3_600.0
    return d.select(*by, "latest", age.alias("age_hours"), (age <= max_age_hours).alias("is_fresh"))


def issue_counts(
    bars: DataFrame,
    as_of: Column,
    *,
    sources: DataFrame | None = None,
    jump: float = 0.10,
    interval_seconds: int = 86_400,
    z_limit: float = 5.0,
    spike: float = 10.0,
    divergence: float = 0.05,
    max_age_hours: float = 48.0,
    by: By = ("symbol",),
    ts: str = "ts",
    stored: bool = True,
) -> DataFrame:
    """Findings per check, with a total row (check NULL). A fresh series is no finding.

    Five checks read the bars, so they are ``stored`` first.
    """
    if stored:
        bars = cut(bars)
    checks = {
        "flash_crashes": price_jumps(bars, jump, by=by, ts=ts),
        "data_gaps": gaps(bars, interval_seconds, by=by, ts=ts),
        "extreme_outliers": extreme_values(bars, z_limit, by=by, ts=ts),
        "volume_anomalies": volume_anomalies(bars, spike, by=by, ts=ts),
        "data_freshness": freshness(bars, as_of, max_age_hours, by=by, ts=ts).filter(~F.col("is_fresh")),
    }
    if sources is not None:
        checks["source_divergence"] = source_divergence(sources, divergence, by=by, ts=ts)
    tall = None
    for name, found in checks.items():
        part = found.select(F.lit(name).alias("check"))
        tall = part if tall is None else tall.unionByName(part)
    return tall.rollup("check").agg(F.count(F.lit(1)).alias("issues"))
