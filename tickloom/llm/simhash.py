"""SimHash near duplicates by multi-index hashing.

A text's fingerprint has 64 bits: a bit is 1 if over half the hashes of its shingles have it. Two fingerprints are linked when
they differ in few bits. Equal fingerprints are one node from the start, so copies of a text cost one node.

Multi-index hashing cuts a fingerprint into segments. If two differ in at most ``radius`` bits, some segment differs in no more
than its share of them, so the small Hamming ball of that segment is enumerated, the table of the segment is asked for every
value of the ball, and the full distances of the matches are verified. A pair is taken in the first segment that finds it.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import chain, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.session import stage

from .common import LOWER_BYTES, record, texts
from .graph import components

BITS = 64
#: Shingles that are hashed at once, so that a very long text needs no more memory than its words.
BLOCK = 1 << 16
#: A probe that is shuffled costs about as much as comparing this many fingerprints of a table's bucket.
PROBE_COST = 10

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The fingerprint of a text as a signed long; zero without words."""
    w = text.translate(LOWER_BYTES).split()
    n = max(len(w) - words + 1, 1)
    if not w:
        return 0
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, BLOCK):
        part = w[i : i + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)))) if len(part) >= words else [b" ".join(part)]
        h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype="<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row: 64 bits over its lower-cased (A-Z) word shingles, repeats included.

    A null or empty text, or one without words, has fingerprint zero; fewer words than ``words`` are one shingle. Very long texts are
    hashed in blocks. Null and repeated ids stay rows of their own; other columns are not read.
    """

    def batches(it):
        for b in it:
            yield record(FINGERPRINTS, b.column("doc_id"), [fingerprint(t, words, seed) for t in texts(b)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, fp long")


def segment_plan(n: int, radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius of the ball) of each segment, for ``n`` fingerprints.

    Radii that sum to ``radius`` + 1 - segments miss no pair: one that exceeded all of them would differ in over ``radius`` bits. More
    segments mean fewer probes and fuller buckets; the cheapest number for ``n`` that leaves a ball to enumerate is taken. Every number
    finds the same pairs.
    """

    def cut(m: int) -> list[tuple[int, int, int]]:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        spare, extra = divmod(radius + 1 - m, m)
        return [(sum(widths[:i]), w, spare + (i < extra)) for i, w in enumerate(widths)]

    def cost(plan: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(w, k) for k in range(r + 1)) * (PROBE_COST + n / 2.0**w) for _, w, r in plan)

    return min((cut(m) for m in range(1, max(radius, 1) + 1)), key=cost)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _mask(first: int, width: int) -> int:
    return _signed(((1 << width) - 1) << first)


def _ball(first: int, width: int, radius: int) -> list[int]:
    """All ways to flip at most ``radius`` bits of a segment."""
    flips = chain.from_iterable(combinations(range(first, first + width), k) for k in range(radius + 1))
    return [_signed(sum(1 << b for b in f)) for f in flips]


def _flat(plan, of) -> Column:
    """One row per (segment, value) that ``of`` gives for a segment."""
    return F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), v.alias("key")) for s, part in enumerate(plan) for v in of(*part)]))


def close_pairs(nodes: DataFrame, plan: list[tuple[int, int, int]], radius: int) -> DataFrame:
    """(fp, group, fp_b, group_b) of all pairs of distinct fingerprints of different groups at most ``radius`` bits apart, fp < fp_b.

    ``nodes`` holds (fp, group), fp unique. Probes whose bucket holds nothing but their own group are dropped by a join with one row
    per bucket, so members of a large group that is known already never meet; a mixed bucket compares in the join and gives only the links.
    """
    table = nodes.select("fp", "group", _flat(plan, lambda first, width, r: [F.col("fp").bitwiseAND(F.lit(_mask(first, width)))]).alias("at"))
    table = table.select("at.seg", "at.key", F.col("fp").alias("fp_b"), F.col("group").alias("group_b"))
    buckets = table.groupBy("seg", "key").agg(F.min("group_b").alias("low"), F.max("group_b").alias("high"))
    probes = nodes.select(
        "fp", "group", _flat(plan, lambda first, width, r: [F.col("fp").bitwiseXOR(F.lit(x)).bitwiseAND(F.lit(_mask(first, width))) for x in _ball(first, width, r)]).alias("at")
    ).select("fp", "group", "at.seg", "at.key")
    probes = probes.join(buckets, ["seg", "key"]).filter("low <> group OR high <> group").drop("low", "high")
    differ = F.col("fp").bitwiseXOR(F.col("fp_b"))
    # the pair belongs to the first segment that finds it
    missed = [F.bit_count(differ.bitwiseAND(F.lit(_mask(first, width)))) > r for first, width, r in plan]
    first_found = reduce(lambda x, s: x & ((F.col("p.seg") <= s) | missed[s]), range(len(plan)), F.lit(True))
    here = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key"))
    linked = here & (F.col("fp") < F.col("fp_b")) & (F.col("group") != F.col("group_b")) & (F.bit_count(differ) <= radius) & first_found
    return probes.alias("p").join(table.alias("t"), linked).select("fp", "group", "fp_b", "group_b")


def one_bit_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of fingerprints that differ in one bit; the ball of the whole fingerprint is looked up among the nodes."""
    ball = F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in _ball(0, BITS, 1)])
    probes = nodes.select(F.col("fp").alias("a"), F.explode(ball).alias("b")).filter("a < b")
    return probes.join(nodes.select(F.col("fp").alias("b")), "b").select("a", "b")


def near_duplicates(docs: DataFrame, *, radius: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable by links of at most ``radius`` differing bits.

    Fingerprints that differ in one bit are grouped first (a ball of one bit in a single segment of all 64: no fingerprint has over
    64 such links, however large its group); the segments then only look for links between different groups.

    Texts without words share fingerprint zero and are linked like any other. Rows with a null doc_id take part, but name no component;
    a component of such rows alone has a null id. Repeated rows are one node and come out once each. An empty table gives no rows;
    further columns are not read.
    """
    prints = stage(fingerprints(docs, words=words, seed=seed), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    grouped = nodes.withColumn("group", F.col("fp"))
    if radius:
        grouped = _relabel(grouped, components(one_bit_pairs(nodes)))
    grouped = stage(grouped, "groups")
    if radius > 1:
        links = close_pairs(grouped.select("fp", "group"), segment_plan(grouped.count(), radius), radius)
        links = links.select(F.col("group").alias("a"), F.col("group_b").alias("b"))
        grouped = _relabel(grouped, components(links))
    names = grouped.groupBy("group").agg(F.min("first_doc").alias("component_id"))
    # groups and copies may be large on these two joins, whose other sides hold one row per key
    named = grouped.select("fp", "group").join(names, "group").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _relabel(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``group`` replaced by the component it belongs to, if it has links."""
    found = found.select(F.col("node").alias("group"), "component")
    return nodes.join(found, "group", "left").withColumn("group", F.coalesce("component", "group")).select("fp", "first_doc", "group")
