"""Connected components of links that may hold hubs with a large share of all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.session import discard, stage


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").bitwiseAND((1 << 40) - 1))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b longs): the smallest node that it can reach.

    Alternates two steps until nothing changes, a logarithmic number of rounds: every node hands the smallest
    neighbour to its larger ones, then to its smaller ones. Both take the smallest neighbour by a pre-aggregated
    minimum and a join, so a hub's neighbours never meet in one task. Every round is written to the shared folder.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stage(edges, "edges")
    before = _tally(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        large = stage(large, "edges")
        discard(edges)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stage(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(large)
        after = _tally(edges)
        if after == before:
            break
        before = after
    own = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
    return own.unionByName(roots.select("node", F.col("node").alias("component")))
