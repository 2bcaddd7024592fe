"""Bar files and result tables: readers, writers, column clean-up."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import BARS, OHLCV
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_bars(spark: SparkSession, path: str | list[str], fmt: str = "csv", schema: T.StructType = BARS) -> DataFrame:
    """Bars from CSV (header) or Parquet; ``path`` may be a file, a folder or a glob. No schema inference."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"):
    """Parquet by default; partitioning by symbol lets readers prune."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines."""
    df.write.mode("errorifexists").json(path)


def read_newest(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    key: str,
    required: Sequence[str] = (),
    max_age_hours: float = 24.0,
    now: Column | None = None,
) -> DataFrame:
    """JSON results: per key the rows of the newest file that is fresh and has the required fields."""
    now = F.current_timestamp() if now is None else now
    rows = spark.read.schema(schema).json(path).select(
        "*", F.col("_metadata.file_modification_time").alias("_mtime"), F.col("_metadata.file_path").alias("_file")
    )
    rows = rows.filter(F.col("_mtime") >= now - F.expr(f"interval {int(max_age_hours * 3600)} seconds"))
    for c in required:
        rows = rows.filter(F.col(c).isNotNull())
    newest = rows.groupBy(key).agg(F.max_by("_file", F.struct("_mtime", "_file")).alias("_file"))
    return rows.join(newest, [key, "_file"]).drop("_file", "_mtime")


def standardise_columns(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """Lower-case names, use the adjusted close when there is no plain one, insist on OHLCV."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    for old, new in ({"adj close": "close", "timestamp": "ts"} | (rename or {})).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [c for c in OHLCV if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def with_timestamp(df: DataFrame, column: str = "timestamp", out: str = "ts", fmt: str | None = None) -> DataFrame:
    """Parse the time column; the order lives in the windows, so nothing is sorted here."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "string":
        c = F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else c.cast("timestamp_ntz")
    return df.withColumn(out, c)
