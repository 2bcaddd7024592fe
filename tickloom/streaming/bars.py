"""Streams of ticks and bars: sources, bars, dedup, static limits, scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.models import score
from ..operators.series import By
from ..schema import OHLCV
from ..session import stage
from ..sources.files import scratch


def file_stream(spark: SparkSession, path: str, schema, *, pattern: str | None = None, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the time column becomes a (UTC) timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def stream_bars(
    ticks: DataFrame,
    *,
    by: By = ("symbol",),
    interval: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    ts: str = "ts",
    price: str = "price",
    size: str = "size",
    order: Sequence[str] = (),
) -> DataFrame:
    """OHLCV bars of a tick stream, in event time. Ticks later than ``delay`` are dropped; in append mode a bar
    comes out once the watermark has passed its end, so the newest bars of a stream that stops stay in its state until it is
    closed (``run``). State is one row per open (series, bar). Ticks of equal time are ordered by ``order``, then by price.
    ``until``, the last moment of a bar, carries the watermark to operators further on in the same job."""
    window = F.window(ts, interval, slide) if slide else F.window(ts, interval)
    place = F.struct(ts, *order, price)
    out = (
        ticks.withWatermark(ts, delay)
        .groupBy(*by, window.alias("_w"))
        .agg(
            F.min_by(price, place).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, place).alias("close"),
            F.sum(size).alias("volume"),
        )
    )
    return out.select(*by, F.col("_w.start").alias(ts), *OHLCV, F.window_time("_w").alias("until"))


def stream_sessions(
    ticks: DataFrame, gap: str = "30 minutes", *, by: By = ("symbol",), delay: str = "1 hour", ts: str = "ts", price: str = "price", size: str = "size", order: Sequence[str] = ()
) -> DataFrame:
    """Bursts of activity: ticks of a series no more than ``gap`` apart share a session, with its span, ticks and OHLCV.

    Of a stream, state is one row per open session, and sessions that a tick brings together are merged; of a table, the same
    aggregate runs at once. ``end`` is the last tick's time plus the gap.
    """
    place = F.struct(ts, *order, price)
    d = ticks.withWatermark(ts, delay) if ticks.isStreaming else ticks
    out = d.groupBy(*by, F.session_window(ts, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("ticks"), F.min_by(price, place).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.sum(size).alias("volume"),
    )
    return out.select(*by, F.col("_w.start").alias(ts), F.col("_w.end").alias("end"), "ticks", *OHLCV)


def stream_dedup(df: DataFrame, keys: Sequence[str], *, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First row per key; keys are remembered for ``delay`` of event time."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_limits(ticks: DataFrame, limits: DataFrame, *, by: By = ("symbol",), price: str = "price") -> DataFrame:
    """Ticks outside the (static) low / high limits of their series. The join side is chosen by its size at run time."""
    d = ticks.join(limits, [*by])
    breach = F.when(F.col(price) > F.col("high_limit"), "high").when(F.col(price) < F.col("low_limit"), "low")
    return d.withColumn("breach", breach).filter("breach is not null")


#: The time of a closing row, after all others, and within what pandas can hold.
FAR = "2200-01-01"


def closing(stream: DataFrame, *, ts: str = "ts") -> tuple[DataFrame, str]:
    """A stream that can be closed: the stream united with a folder that is empty until ``run`` writes a closing row into it."""
    spark = stream.sparkSession
    folder = scratch(spark, "closing")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), folder


def run(
    df: DataFrame, name: str, *, mode: str = "append", target: str | None = None, feed: Sequence[Callable[[], None]] = (), close: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Process what is there, then stop; returns the written table. Progress and state live in shared storage.

    With ``feed`` that is done once after each of its calls. ``close`` is the folder of ``closing``: at the end a row without
    series and of the time FAR moves the watermark past all data, so what waits for it comes out. No later row is
    accepted then. Rows of FAR are not returned.
    """
    spark = df.sparkSession
    target = target or scratch(spark, name)
    progress = scratch(spark, f"{name}-progress")

    def go() -> None:
        q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start(target)
        q.awaitTermination()

    for f in feed or (lambda: None,):
        f()
        go()
    if close is None:
        return spark.read.schema(df.schema).parquet(target)
    kinds = spark.read.parquet(close).schema
    last = spark.range(1).select(*[(F.lit(FAR) if c.name == ts else F.lit(None)).cast(c.dataType).alias(c.name) for c in kinds])
    last.write.mode("append").parquet(close)
    go()
    return spark.read.schema(df.schema).parquet(target).filter(F.col(ts) < F.lit(FAR).cast("timestamp") - F.expr("INTERVAL 1 YEAR"))


def run_scoring(
    bars: DataFrame, models: dict[str, PipelineModel], *, target: str | None = None, name: str = "scores", feed: Sequence[Callable[[], None]] = ()
) -> DataFrame:
    """Score every micro-batch and append it as a folder of its own, so a repeated batch replaces itself."""
    spark = bars.sparkSession
    target = target or scratch(spark, name)
    progress = scratch(spark, f"{name}-progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        score(models, batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    for f in feed or (lambda: None,):
        f()
        q = bars.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(target)


class Replay(NamedTuple):
    """A folder that is fed with a table, part by part: each call of ``feed`` appends the next one."""

    path: str
    schema: StructType
    feed: list[Callable[[], None]]


def replay(df: DataFrame, *, parts: int = 3, ts: str = "ts", part: Column | None = None) -> Replay:
    """A table to be read back as a stream in ``parts`` runs, by time or by the number ``part`` (from 0).

    The table is stored once, a folder per part; each part is written by as many tasks as read it. ``run`` feeds a part, then
    processes what is new, so a part is one micro-batch of many files.
    """
    spark = df.sparkSession
    path, table = scratch(spark, "replay"), scratch(spark, "replay-parts")
    if part is None:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        df = stage(df, "replay-rows")
        span = df.agg(F.min(micros), F.max(micros)).first()
        width = max(((span[1] or 0) - (span[0] or 0)) / parts, 1)
        part = F.least(F.floor((micros - (span[0] or 0)) / width), F.lit(parts - 1))
    kinds = df.schema
    df.limit(0).write.parquet(path)
    df.withColumn("part_", part.cast("int")).write.partitionBy("part_").parquet(table)

    def feeder(i: int) -> Callable[[], None]:
        rows = spark.read.schema(StructType([*kinds, StructField("part_", IntegerType())])).parquet(table).filter(F.col("part_") == i)
        return lambda: rows.drop("part_").write.mode("append").parquet(path)

    return Replay(path, kinds, [feeder(i) for i in range(parts)])
