"""Registry of the checked queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Of each per-bar query: column -> digits (None: not rounded), and its SQL for given bars, so that other queries can ask for the same columns.
COLUMNS: dict[str, tuple[dict[str, int | None], Callable[..., str]]] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def show(df: DataFrame, keys: Sequence[str], digits: int, columns: Sequence[str], raw: Sequence[str] = ()) -> DataFrame:
    """Keys as they are, doubles rounded like in the SQL; ``raw`` columns (plain inputs) are left alone."""

    def value(c: str):
        x = F.col(c).cast("double")
        return (x if c in raw else F.round(x, digits)).alias(c)

    return df.select(*keys, *[value(c) for c in columns])


def rr(digits: int, raw: Sequence[str] = (), **exprs: str) -> str:
    """SQL select list with every expression rounded."""
    return ", ".join(
        f"CAST({e} AS DOUBLE) AS {n}" if n in raw else f"round(CAST({e} AS DOUBLE), {digits}) AS {n}" for n, e in exprs.items()
    )


# SQL spellings of the window vocabulary

KEY = "PARTITION BY symbol ORDER BY ts"


def w(n: int, key: str = KEY) -> str:
    return f"({key} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, need: int | None = None, key: str = KEY) -> str:
    need = n if need is None else need
    call = f.format(x) if "{}" in f else f"{f}({x})"
    if need <= 1:
        return f"{call} OVER {w(n, key)}"
    return f"CASE WHEN count({x}) OVER {w(n, key)} >= {need} THEN {call} OVER {w(n, key)} END"


def lag(x: str, k: int = 1, key: str = KEY) -> str:
    return f"lag({x}, {k}) OVER ({key})"


def pct(x: str, k: int = 1, key: str = KEY) -> str:
    return f"({x} / nullif({lag(x, k, key)}, 0) - 1)"


def so_far(call: str, key: str = KEY) -> str:
    return f"{call} OVER ({key} ROWS UNBOUNDED PRECEDING)"


def columns_query(
    name: str,
    bars: Query,
    bars_sql: str,
    compute: Callable[[DataFrame], DataFrame],
    columns: dict[str, str],
    *,
    digits: int = 6,
    ctes: Sequence[str] = (),
    source: str = "bars",
    keys: Sequence[str] = ("symbol", "ts"),
    recursive: bool = False,
    raw: Sequence[str] = (),
) -> None:
    """A per-bar feature query: ``compute`` adds the columns, ``columns`` gives their SQL."""

    def sql(of_bars: str, nudge: float = 0.0) -> str:
        nudged = {c: f"({e}) + {nudge!r}" if nudge and c not in raw else e for c, e in columns.items()}
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([of_bars, *ctes])} SELECT {', '.join(keys)}, {rr(digits, raw, **nudged)} FROM {source}"

    COLUMNS[name] = {c: None if c in raw else digits for c in columns}, sql
    register(name, lambda spark, sf: show(compute(bars(spark, sf)), keys, digits, list(columns), raw), sql(bars_sql))
