"""Mixing sources to target weights: whole documents whose sizes add up to each source's budget.

Documents are counted by exact size; a source's budget is whole rounds over all its documents plus a rest. The rest
is spread over the sizes in proportion to their counts, then filled from the largest size down, and what is left,
less than the largest size, is closed by a bounded-knapsack dynamic programme over the counts still free, to the nearest sum on either side. Only then are
documents named: in each size, those with the smallest seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.session import stage

from .common import words

GROUP = 1024  # documents of one size that one ranking group holds on average


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3) -> dict[str | None, float]:
    """Words for each source: all words shared by weight, at most ``max_repeat`` times what a source has.

    Sources in code point order, null last, take the weights in turn. What exceeds a source's limit is shared
    among the others by weight until nobody is above. Sources without words get 0.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), list(names), {}
    while free:
        whole = sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        full = [s for s in free if share[s] > max_repeat * sizes[s]]
        if not full:
            return out | share
        out |= {s: float(max_repeat * sizes[s]) for s in full}
        left -= sum(max_repeat * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


#: Sums that the exchange of documents looks at on each side of the budget; all that matter while the largest size is under 180.
WINDOW = 1 << 17


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each size to take so that their sizes add up to ``budget`` or, failing that, come nearest to it.

    A proportional start is filled up by a bounded knapsack over additions. If that misses the budget, a second one over additions and
    removals looks for the nearest sum: some best choice differs from any start near the budget in at most 4 M + 1 documents, M the
    largest size, since in a longer exchange some part sums to zero. Work and memory follow the sizes, not the number of documents.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if total <= budget:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:
        more = min(counts[i] - take[i], left // sizes[i])
        take[i] += more
        left -= more * sizes[i]
    filled = _knapsack(sizes, counts, list(take), left)
    rest = budget - sum(s * t for s, t in zip(sizes, filled, strict=True))
    return filled if not rest else _exchange(sizes, counts, filled, rest)


def _exchange(sizes: Sequence[int], counts: Sequence[int], take: list[int], left: int) -> list[int]:
    """Additions and removals that bring the sum nearest to ``left`` more than it is, on a bit set of changes around zero."""
    most = max(sizes)
    around = min(4 * most * (most + 1), WINDOW) + abs(left)
    steps, reach, goal = [], 1 << around, around + left
    mask = (1 << (2 * around + 1)) - 1
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        for sign, free in ((1, counts[i] - take[i]), (-1, take[i])):
            free, chunk = min(free, 4 * most + 1, around // sizes[i]), 1
            while free > 0 and not reach >> goal & 1:
                k = min(chunk, free)
                move = k * sizes[i]
                grown = (reach | (reach << move if sign > 0 else reach >> move)) & mask
                if grown != reach:
                    steps.append((i, sign * k, reach))
                    reach = grown
                free, chunk = free - k, chunk * 2
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach >> goal
    over = goal + (above & -above).bit_length() - 1 if above else None
    at = below if over is None or 0 <= goal - below <= over - goal else over
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * sizes[i]
    return take


def _knapsack(sizes: Sequence[int], counts: Sequence[int], take: list[int], left: int) -> list[int]:
    """Bounded knapsack over a bit set of reachable sums up to twice ``left``; bit s of an int stands for the sum s."""
    mask = (1 << (2 * left + 1)) - 1
    reach, steps = 1, []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        free, chunk = min(counts[i] - take[i], 2 * left // sizes[i]), 1
        while free > 0 and not reach >> left & 1:
            k = min(chunk, free)
            grown = (reach | reach << (k * sizes[i])) & mask
            if grown != reach:
                steps.append((i, k, reach))
                reach = grown
            free, chunk = free - k, chunk * 2
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    over = (above & -above).bit_length() - 1 if above else left + 1
    at = left + over if over < left - below else below
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * sizes[i]
    return take


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 11, size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): every row of ``docs`` with the copies that the mix takes.

    ``size`` is the words of the text by default. A null source is a source of its own. Empty and null texts have size
    0 and no copies. Rows with equal ids or texts are documents of their own; ties in the seeded hash go by doc_id, and equal
    rows among themselves are interchangeable. An empty table gives no rows. Same rows, same result, in any partitioning.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    d = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("dice"))
    d = stage(d, "sizes")
    hist = stage(d.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    # one row per source: its words and target
    totals = {r["source"]: int(r["words"] or 0) for r in d.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    goal = source_targets(totals, weights, max_repeat)
    plan = spark.createDataFrame([(s, totals[s], float(goal[s])) for s in totals], "source string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = pdf["size"].tolist(), pdf["n"].tolist()
        words_, budget = int(pdf["source_size"].iloc[0]), round(pdf["target"].iloc[0])
        rounds = min(max_repeat, budget // words_)
        rest = fit_budget(sizes, counts, budget - rounds * words_) if rounds < max_repeat else [0] * len(sizes)
        return pdf[["source", "size", "n"]].assign(rounds=rounds, extra=rest)

    goals = hist.join(plan, hist["source"].eqNullSafe(plan["source"])).select(hist["source"], "size", "n", "source_size", "target")
    fitted = goals.groupBy("source").applyInPandas(fit, "source string, size long, n long, rounds int, extra long")
    fitted = stage(fitted, "size-takes").withColumn("groups", F.greatest(F.lit(1), (F.col("n") / GROUP).cast("long")))
    f = fitted.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "rounds", "extra", "groups")
    on = d["source"].eqNullSafe(f["f_source"]) & (d["size"] == f["f_size"])
    drawn = stage(d.join(f, on, "left").withColumn("grp", F.pmod("dice", "groups")).drop("f_source", "f_size", "groups"), "draws")
    # the documents of a size in groups of the hash; whole groups are taken up to the one that the count ends in
    open_ = drawn.filter("extra > 0")
    filled = open_.groupBy("source", "size", "grp").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(W.partitionBy("source", "size").orderBy("grp").rowsBetween(W.unboundedPreceding, -1))
    filled = filled.select(F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.col("grp").alias("g"), F.coalesce(before, F.lit(0)).alias("before"))
    on = open_["source"].eqNullSafe(filled["g_source"]) & (open_["size"] == filled["g_size"]) & (open_["grp"] == filled["g"])
    nth = F.row_number().over(W.partitionBy("source", "size", "grp").orderBy("dice", "doc_id"))
    ranked = open_.join(filled, on).withColumn("more", (F.col("before") + nth <= F.col("extra")).cast("int"))
    columns = ["doc_id", "source", "size", "rounds", "more"]
    rest = drawn.filter("extra IS NULL OR extra <= 0").withColumn("more", F.lit(0)).select(columns)
    took = ranked.select(columns).unionByName(rest).withColumn("copies", F.coalesce(F.col("rounds"), F.lit(0)) + F.col("more"))
    plan = plan.withColumnRenamed("source", "p_source")
    return took.join(plan, took["source"].eqNullSafe(plan["p_source"])).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
