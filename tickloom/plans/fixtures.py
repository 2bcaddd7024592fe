"""Market views of the supplied tables, as DataFrames and as the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.series import Blocks
from ..sources.bars import pack_order, ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_ticks(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    """Line items as ticks: price per piece, piece count, shipping day; ``seq`` orders the ticks of a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        pack_order(("l_orderkey", 13), ("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 11)).alias("seq"),
    )


def line_blocks(rows: int = 100_000, day: str = "ts", part: str = "seq") -> Blocks:
    """Blocks of line-item ticks: days, split further by ranges of 2**20 orders, so a bucket stays at task size."""
    order_range = F.floor(F.col(part).cast("double") / (1e25 * 2**20)) if part == "seq" else F.floor(F.col(part) / 2**20)
    return Blocks(rows, (F.col(day), order_range))


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("source"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
        F.col("event_id").alias("seq"),
    )


def flag_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of three long series."""
    return ticks_to_bars(line_ticks(spark, sf_dir, "l_returnflag"), interval="1 day", order=["seq"])


def supp_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of one series per supplier; the number of series grows with the data."""
    return ticks_to_bars(line_ticks(spark, sf_dir, "l_suppkey"), interval="1 day", order=["seq"])


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(event_ticks(spark, sf_dir), interval="1 hour")


def source_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the same symbols from two sources."""
    return ticks_to_bars(event_ticks(spark, sf_dir), by=("symbol", "source"), interval="1 hour")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("size"),
        F.col("o_orderkey").alias("seq"),
    )
    return ticks_to_bars(ticks, interval="1 day", order=["seq"])


# --- the same views in SQL ----------------------------------------------------------------------

_BAR = (
    "arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume"
)


def line_ticks_sql(symbol: str) -> str:
    return (
        f"ticks AS (SELECT CAST({symbol} AS VARCHAR) AS symbol, l_shipdate AS ts, "
        "l_extendedprice / l_quantity AS p, l_quantity AS q, "
        "row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"
    )


EVENT_TICKS_SQL = (
    "ticks AS (SELECT event_type AS symbol, 's' || CAST(user_id % 2 AS VARCHAR) AS source, ts, "
    "value AS p, 1.0::DOUBLE AS q, ts AS k, event_id AS seq FROM events)"
)


def _bars_sql(ticks: str, unit: str, keys: str = "symbol") -> str:
    return f"{ticks}, bars AS (SELECT {keys}, date_trunc('{unit}', ts)::TIMESTAMP AS ts, {_BAR} FROM ticks GROUP BY ALL)"


FLAG = _bars_sql(line_ticks_sql("l_returnflag"), "day")
SUPP = _bars_sql(line_ticks_sql("l_suppkey"), "day")
HOUR = _bars_sql(EVENT_TICKS_SQL, "hour")
SOURCES = _bars_sql(EVENT_TICKS_SQL, "hour", "symbol, source")
ORDERS = _bars_sql(
    "ticks AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS p, 1.0::DOUBLE AS q, o_orderkey AS k FROM orders)",
    "day",
)
