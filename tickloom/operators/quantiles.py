"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .series import By


def exact_quantiles(
    df: DataFrame,
    x: str,
    probs: Sequence[float],
    *,
    by: By = ("symbol",),
    cells: int = 4096,
    leaf: int = 100_000,
) -> DataFrame:
    """Linear-interpolated quantiles (by..., prob, value), without ever holding a group in one task.

    Each pass counts the values of a group in ``cells`` equal cells (combined map-side), finds the cells
    that hold the wanted ranks, and narrows the range to them; it stops when the cells left hold at most
    ``leaf`` rows each or a single value. The driver only learns how many rows are still open. A range's ends never
    share a cell, so every pass narrows it; should one not (infinite values), this raises.
    """
    rows = cut(df.select(*by, F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull()))
    sizes = rows.groupBy(*by).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # rank p*(n-1) lies between two order statistics; look for both
    ends = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), F.lit(side).alias("side"), (r + side).alias("rank"))
            for p in probs
            for r in [F.floor(F.lit(float(p)) * (F.col("_n") - 1))]
            for side in (0, 1)
        ]
    )
    todo = sizes.select(*by, "_n", "_lo", "_hi", F.explode(ends).alias("_e")).select(
        *by, "_n", "_lo", "_hi", "_e.*", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in")
    )
    todo = cut(todo.withColumn("rank", F.least("rank", F.col("_n") - 1)))
    done = (F.col("_in") <= leaf) | (F.col("_lo") == F.col("_hi"))
    before = None
    while (left := todo.filter(~done).agg(F.sum(F.col("_in").cast("double"))).first()[0]) is not None:
        if before is not None and left >= before:
            raise RuntimeError(f"quantiles of {x}: the ranges don't narrow; are all values finite?")
        before = left
        # ranks of one group often share a range: count each range once
        ranges = todo.filter(~done).select(*by, "_lo", "_hi").distinct()
        cell = F.least(
            F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells), F.lit(cells - 1)
        ).cast("long")
        counted = (
            rows.join(ranges, [*by])
            .filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*by, "_lo", "_hi", cell.alias("_cell"))
            .agg(F.count("_x").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        )
        order = Window.partitionBy(*by, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("_upto", F.sum("_c").over(order))
        open_, closed = todo.filter(~done), todo.filter(done)
        hit = open_.join(counted, [*by, "_lo", "_hi"]).filter(
            (F.col("rank") - F.col("_below") >= F.col("_upto") - F.col("_c"))
            & (F.col("rank") - F.col("_below") < F.col("_upto"))
        )
        narrowed = hit.select(
            *by,
            "_n",
            F.col("_a").alias("_lo"),
            F.col("_b").alias("_hi"),
            "prob",
            "side",
            "rank",
            (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"),
            F.col("_c").alias("_in"),
        )
        todo = cut(narrowed.unionByName(closed.select(*narrowed.columns)))
    ranges = todo.select(*by, "_lo", "_hi").distinct()
    inside = Window.partitionBy(*by, "_lo", "_hi").orderBy("_x")
    leaves = (
        rows.join(ranges.filter(F.col("_lo") < F.col("_hi")), [*by])
        .filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_r", F.row_number().over(inside).cast("long") - 1)
        .select(*by, "_lo", "_hi", "_r", "_x")
    )
    found = todo.withColumn("_r", F.col("rank") - F.col("_below")).join(leaves, [*by, "_lo", "_hi", "_r"], "left")
    value = F.coalesce("_x", "_lo")
    pair = found.groupBy(*by, "prob").agg(
        F.max(F.when(F.col("side") == 0, value)).alias("_v0"),
        F.max(F.when(F.col("side") == 1, value)).alias("_v1"),
        F.max("_n").alias("_n"),
    )
    pos = F.col("prob") * (F.col("_n") - 1)
    return pair.select(*by, "prob", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (pos - F.floor(pos))).alias("value"))
