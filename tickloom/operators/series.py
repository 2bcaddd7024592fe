"""Ordered computation over many series: rolling, running and affine recurrences.

A *series* is the set of rows that share the ``by`` columns, ordered by ``ts``. Every
operator comes in two physical forms with the same result:

* ``blocks=None`` - one window per series. Right for bars: a bar table has one row per
  (series, grid slot), so a series holds at most calendar span / bar interval rows
  (100 years of daily bars: 36,525; of hourly bars: 876,600) however many ticks went in.
* ``blocks=Blocks(rows, bucket)`` - a series is cut into blocks of ``rows`` rows that are
  shuffled and sorted independently, for tick tables where one series can hold a third of
  all rows. Rolling windows copy a halo of neighbour rows, running aggregates and
  recurrences add a carry per block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import require
from ..session import cut, stage

By = Sequence[str]
Step = Callable[["Frame"], dict[str, Column]]
MAX_LOG_POWER = 460.0  # 1e-200: room for what is divided by it


@dataclass(frozen=True)
class Blocks:
    """How to cut long series.

    ``bucket`` lists columns that never decrease along the order of the rows (a day, an
    hour, an id range). They only serve to number the rows without sorting a whole series
    in one task, so any split that keeps a bucket to task size will do.
    """

    rows: int
    bucket: tuple[Column, ...]


@dataclass(frozen=True)
class Frame:
    """Window vocabulary over one series (or one block of it)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def spec(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def back(self, n: int):
        """The current row and the n-1 rows before it."""
        return self.spec.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self):
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self):
        return self.spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def lag(self, x: Column | str, k: int = 1, default=None) -> Column:
        return F.lag(x, k, default).over(self.spec)

    def lead(self, x: Column | str, k: int = 1, default=None) -> Column:
        return F.lead(x, k, default).over(self.spec)

    def roll(self, f: Callable, x: Column | str, n: int, min_periods: int | None = None) -> Column:
        """Aggregate of the last n rows, NULL until ``min_periods`` of them (default all n) are non-NULL."""
        w = self.back(n)
        need = n if min_periods is None else min_periods
        value = f(x).over(w)
        return value if need <= 1 else F.when(F.count(x).over(w) >= need, value)

    def change(self, x: Column | str, k: int = 1) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return F.try_divide(x, self.lag(x, k)) - 1

    def run(self, f: Callable, x: Column | str) -> Column:
        return f(x).over(self.so_far)


def number_rows(df: DataFrame, by: By, order: By, blocks: Blocks | None, name: str = "_rn") -> DataFrame:
    """0-based position of each row in its series.

    With ``blocks`` the position is (rows in earlier buckets) + (position in the bucket), so no task
    sorts more than one bucket; the running count goes over one row per (series, bucket). Rows that were
    numbered before (``in_blocks``) are left as they are.
    """
    if name in df.columns:
        return df
    if blocks is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long") - 1)
    names = [f"_b{i}" for i in range(len(blocks.bucket))]
    d = df.select("*", *[c.alias(n) for c, n in zip(blocks.bucket, names)])
    earlier = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        d.groupBy(*by, *names)
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(*by, *names, F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*by, *names).orderBy(*order)
    return (
        d.join(starts, [*by, *names])
        .withColumn(name, F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_off", *names)
    )


def number_times(df: DataFrame, ts: str = "ts", name: str = "pos_") -> DataFrame:
    """0-based place of each row's time among all times of the table. Times are bounded by the calendar, so one sort of them is small."""
    times = df.select(ts).distinct().select(ts, (F.row_number().over(Window.orderBy(ts)) - 1).cast("long").alias(name))
    return df.join(times, ts).select(*df.columns, name)


def in_blocks(df: DataFrame, by: By, order: By, blocks: Blocks) -> DataFrame:
    """Number the rows and cut the series into blocks once, ahead of several blocked operators (``_rn``, ``_blk``)."""
    if "_blk" in df.columns:
        return df
    d = number_rows(df, by, order, blocks)
    return d.withColumn("_blk", F.floor(F.col("_rn") / blocks.rows).cast("long"))


def cut_long(df: DataFrame, by: By, blocks: Blocks) -> tuple[DataFrame, DataFrame | None]:
    """Adds ``_blk`` without numbering rows: 0 for a series of at most ``blocks.rows`` rows; longer ones are cut between buckets.

    Returns all rows, and the stored rows of the long series alone (None: there are none). Blocks of a series ascend with its rows, are of
    about ``blocks.rows`` rows and may leave out numbers. Only rows of long series move for it. Rows without a series or bucket have no place and are left out.
    """
    names = [f"_b{i}" for i in range(len(blocks.bucket))]
    known = df.filter(F.forall(F.array(*[c.isNotNull() for c in (*map(F.col, by), *blocks.bucket)]), lambda x: x))
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_cnt"))
    sizes = stage(sizes.filter(F.col("_cnt") > blocks.rows).select(*by), "long")
    if sizes.isEmpty():
        return known.withColumn("_blk", F.lit(0).cast("long")), None
    d = known.join(sizes, [*by]).select("*", *[c.alias(n) for c, n in zip(blocks.bucket, names)])
    earlier = Window.partitionBy(*by).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        d.groupBy(*by, *names)
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(*by, *names, F.floor(F.coalesce(F.sum("_cnt").over(earlier), F.lit(0)) / blocks.rows).cast("long").alias("_blk"))
    )
    long = stage(d.join(starts, [*by, *names]).select(*df.columns, "_blk"), "blocks")
    short = known.join(sizes, [*by], "left_anti").withColumn("_blk", F.lit(0).cast("long"))
    return short.select(*df.columns, "_blk").unionByName(long), long


def prepared(df: DataFrame, by: By, ts: str | By, blocks: Blocks | None) -> DataFrame:
    """Stored, numbered input of a chain of operators; the table itself where series are not cut."""
    return df if blocks is None else cut(in_blocks(df, by, (ts,) if isinstance(ts, str) else tuple(ts), blocks))


def staged(df: DataFrame, blocks: Blocks | None) -> DataFrame:
    """Store the result of a blocked operator that the next one reads twice."""
    return df if blocks is None else cut(df)


def apply_steps(df: DataFrame, steps: Sequence[Step], frame: Frame) -> DataFrame:
    """Add the columns of each step; all columns of a step share one sort and one pass."""
    temporary: list[str] = []
    for step in steps:
        added = step(frame)
        temporary += [n for n in added if n.startswith("_")]
        replaced = set(added)
        keep = [F.col(c) for c in df.columns if c not in replaced]
        df = df.select(*keep, *[c.alias(n) for n, c in added.items()])
    return df.drop(*temporary)


def rolling(
    df: DataFrame,
    *steps: Step,
    before: int = 0,
    after: int = 0,
    by: By = ("symbol",),
    ts: str | By = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Run window steps whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    Stacked steps add up: ``before`` is the sum of their reaches.
    """
    order = (ts,) if isinstance(ts, str) else tuple(ts)
    require(df, *by, *order)
    if blocks is None:
        return apply_steps(df, steps, Frame(tuple(by), order))
    if max(before, after) > blocks.rows:
        raise ValueError("a block must be at least as long as the halo")
    size = blocks.rows
    d = in_blocks(df, by, order, blocks)
    home, pos = F.col("_blk"), F.col("_rn") % size
    homes = F.array_compact(
        F.array(home, F.when(pos >= size - before, home + 1), F.when((pos < after) & (home > 0), home - 1))
    )
    d = d.withColumn("_blk", F.explode(homes))
    out = apply_steps(d, steps, Frame((*by, "_blk"), ("_rn",)))
    out = out.filter(F.col("_blk") == F.floor(F.col("_rn") / size))
    return out.drop(*[c for c in ("_blk", "_rn") if c not in df.columns])


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _times(a: Column, b: Column) -> Column:
    return F.coalesce(a * b, a, b)


_RUNNING = {
    "sum": (F.sum, _plus),
    "count": (F.count, _plus),
    "product": (F.product, _times),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(
    df: DataFrame,
    items: dict[str, tuple[str, Column]],
    *,
    by: By = ("symbol",),
    ts: str | By = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Aggregates from the start of the series to the current row.

    ``items`` maps an output name to (sum | count | product | max | min | last, input). With
    ``blocks``: aggregate per block, prefix over the block rows, add the carry inside each block.
    """
    order = (ts,) if isinstance(ts, str) else tuple(ts)
    if blocks is None:
        frame = Frame(tuple(by), order)
        return df.select("*", *[_RUNNING[k][0](x).over(frame.so_far).alias(n) for n, (k, x) in items.items()])
    d = in_blocks(df, by, order, blocks)
    d = d.select("*", *[x.alias(f"_x_{n}") for n, (_, x) in items.items()])

    def block_value(kind: str, x: str) -> Column:
        if kind == "last":
            return F.max_by(x, F.when(F.col(x).isNotNull(), F.col("_rn")))
        return _RUNNING[kind][0](x)

    totals = d.groupBy(*by, "_blk").agg(*[block_value(k, f"_x_{n}").alias(f"_t_{n}") for n, (k, _) in items.items()])
    earlier = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    second = {"count": F.sum}
    carry = totals.select(
        *by,
        "_blk",
        *[second.get(k, _RUNNING[k][0])(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, (k, _) in items.items()],
    )
    inside = Frame((*by, "_blk"), ("_rn",)).so_far
    d = d.select("*", *[_RUNNING[k][0](f"_x_{n}").over(inside).alias(f"_l_{n}") for n, (k, _) in items.items()])
    out = d.join(carry, [*by, "_blk"])
    return out.select(
        *df.columns,
        *[_RUNNING[k][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in items.items()],
    )


def islands(
    df: DataFrame,
    starts: Step,
    name: str = "island",
    *,
    by: By = ("symbol",),
    ts: str | By = "ts",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Number the runs of a series; ``starts`` gives one column that is true on the first row of a run."""
    d = rolling(df, lambda w: {"start_": next(iter(starts(w).values()))}, before=1, by=by, ts=ts, blocks=blocks)
    flag = F.coalesce(F.col("start_"), F.lit(False)).cast("long")
    return running(d, {name: ("sum", flag)}, by=by, ts=ts, blocks=blocks).drop("start_")


# --- affine recurrences -------------------------------------------------------------------------


def _carries(comp: DataFrame, by: By, names: Sequence[str], depth: int, fan: int = 512) -> DataFrame:
    """Value entering each tile, from the composed map (p, s) of every tile: y_out = p * y_in + s.

    Composition is associative, so tiles are folded in groups of ``fan``; only ``depth`` = 0 folds all
    tiles of a series at once, on a list with one entry per tile (or per group of fan**depth tiles).
    """
    entry = F.struct("_tile", *[c for n in names for c in (f"_p_{n}", f"_s_{n}")])

    def fold(arr: Column, n: str, start: Column) -> Column:
        return F.aggregate(arr, start, lambda acc, e: acc * e[f"_p_{n}"] + e[f"_s_{n}"])

    zero = F.lit(0.0)
    if depth == 0:
        g = comp.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_a"))
        g = g.select("*", *[zero.alias(f"_y_{n}") for n in names])
    else:
        d = comp.withColumn("_grp", F.floor(F.col("_tile") / fan).cast("long"))
        g = d.groupBy(*by, "_grp").agg(
            F.array_sort(F.collect_list(entry)).alias("_a"), *[F.product(f"_p_{n}").alias(f"_p_{n}") for n in names]
        )
        upper = g.select(
            *by,
            F.col("_grp").alias("_tile"),
            *[c for n in names for c in (F.col(f"_p_{n}"), fold(F.col("_a"), n, zero).alias(f"_s_{n}"))],
        )
        up = _carries(upper, by, names, depth - 1, fan).withColumnRenamed("_tile", "_grp")
        g = g.drop(*[f"_p_{n}" for n in names]).join(up, [*by, "_grp"])

    def carried(e: Column, i: Column) -> Column:
        head = F.slice(F.col("_a"), F.lit(1), i)
        return F.struct(e["_tile"].alias("_tile"), *[fold(head, n, F.col(f"_y_{n}")).alias(f"_y_{n}") for n in names])

    return g.select(*by, F.explode(F.transform("_a", carried)).alias("_e")).select(*by, "_e.*")


def affine(
    df: DataFrame,
    items: dict[str, tuple],
    *,
    by: By = ("symbol",),
    ts: str | By = "ts",
    tile: int = 256,
    blocks: Blocks | None = None,
) -> DataFrame:
    """y[t] = a[t] * y[t-1] + b[t] per series, with y = 0 before the first row and a > 0.

    Inside a tile of ``tile`` rows the recurrence is closed: with P the running product of a,
    y = P * (carry + running sum of b / P). That is two window passes; the carry of each tile comes from
    folding one (p, s) pair per tile. Tiles are shorter where a power of a constant a would leave the range of doubles. Items are (a, b); for a constant a (a float), P is a power of the number
    of known rows so far, and (a, b, column) names a column that is NULL just where b is, whose count is shared.
    ``df`` is read on both sides of the carry join, so pass a stored table when it is costly to derive.
    NULL inputs leave y as it was.
    """
    order = (ts,) if isinstance(ts, str) else tuple(ts)
    names = list(items)
    d = number_rows(df, by, order, blocks)
    const = {n: v[0] for n, v in items.items() if isinstance(v[0], float)}
    tile = max(1, min([tile, *(int(-MAX_LOG_POWER / math.log(a)) for a in const.values() if a < 1.0)]))
    varying = {n: v[0] for n, v in items.items() if n not in const}
    known = {n: items[n][2] if len(items[n]) > 2 else f"_b_{n}" for n in const}
    d = d.select(
        "*",
        F.floor(F.col("_rn") / tile).cast("long").alias("_tile"),
        *[v[1].alias(f"_b_{n}") for n, v in items.items()],
        *[F.when(a.isNotNull() & items[n][1].isNotNull(), a).otherwise(1.0).alias(f"_a_{n}") for n, a in varying.items()],
    )
    w = Window.partitionBy(*by, "_tile").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    counted = sorted(set(known.values()))
    d = d.select(
        "*",
        *[F.count(c).over(w).alias(f"_k{c}") for c in counted],
        *[F.product(f"_a_{n}").over(w).alias(f"_P_{n}") for n in varying],
    )
    power = {n: F.pow(F.lit(a), F.col(f"_k{known[n]}")) for n, a in const.items()} | {n: F.col(f"_P_{n}") for n in varying}
    term = {n: F.coalesce(F.col(f"_b_{n}") / power[n], F.lit(0.0)) for n in names}
    comp = d.groupBy(*by, "_tile").agg(
        *[F.count(c).alias(f"_k{c}") for c in counted],
        *[F.product(f"_a_{n}").alias(f"_P_{n}") for n in varying],
        *[F.sum(term[n]).alias(f"_q_{n}") for n in names],
    )
    comp = comp.select(
        *by, "_tile", *[c for n in names for c in (power[n].alias(f"_p_{n}"), (power[n] * F.col(f"_q_{n}")).alias(f"_s_{n}"))]
    )
    carry = _carries(staged(comp, blocks), by, names, 0 if blocks is None else 2)
    d = d.select("*", *[F.sum(term[n]).over(w).alias(f"_Q_{n}") for n in names])
    out = d.join(carry, [*by, "_tile"])
    return out.select(
        *[c for c in df.columns if c not in items],
        *[(power[n] * (F.col(f"_y_{n}") + F.col(f"_Q_{n}"))).alias(n) for n in names],
    )


def ewm(
    df: DataFrame,
    items: dict[str, tuple[Column, float, int]],
    *,
    by: By = ("symbol",),
    ts: str | By = "ts",
    blocks: Blocks | None = None,
    extra: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Exponential means: name -> (input, alpha, warm-up).

    Seeded with the first non-NULL input, NULL until ``warm-up`` inputs were seen. All items, and ``extra``
    recurrences given as (a, b), go through one scan. Expects columns, not window expressions, as inputs.
    """
    # items over the same input share its column and its running count
    inputs: dict[str, tuple[str, Column]] = {}
    for x, _, _ in items.values():
        inputs.setdefault(str(x), (f"_in_{len(inputs)}", x))
    of = {n: inputs[str(x)][0] for n, (x, _, _) in items.items()}
    d = prepared(df.select("*", *[x.cast("double").alias(c) for c, x in inputs.values()]), by, ts, blocks)
    d = running(d, {f"_n{c}": ("count", F.col(c)) for c, _ in inputs.values()}, by=by, ts=ts, blocks=blocks)
    d = staged(d, blocks)
    scans = {
        f"_ew_{n}": (
            1.0 - alpha,
            F.col(of[n]) * F.when(F.col(f"_n{of[n]}") == 1, 1.0).otherwise(alpha),
            of[n],
        )
        for n, (_, alpha, _) in items.items()
        if alpha < 1.0
    }
    scans |= {f"_ew_{n}": ab for n, ab in (extra or {}).items()}
    if scans:
        d = affine(d, scans, by=by, ts=ts, blocks=blocks)
    value = {n: F.col(f"_ew_{n}") if f"_ew_{n}" in scans else F.col(of[n]) for n in items}
    return d.select(
        *[c for c in df.columns if c not in items and c not in (extra or {})],
        *[F.when(F.col(f"_n{of[n]}") >= warm, value[n]).alias(n) for n, (_, _, warm) in items.items()],
        *[F.col(f"_ew_{n}").alias(n) for n in extra or {}],
    )
