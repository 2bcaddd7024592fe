"""Documents whose shingle sets are similar, joined by count vectors in an R-tree.

A set's shingles are hashed into groups; the group counts are a point, and the sum of coordinate minima bounds the
overlap of two sets from above, for two boxes by their upper corners. Boxes over unrelated long texts all overlap,
so the tree's upper level is exact routing: sets within reach of each other differ in at most k shingles, so at most k of the
filled ranges of hash space differ in content. Whatever common order the contents have, the first that both sets share is among the
k + 1 first of each; the order is by how many sets hold a content, rare ones first, so a line that many texts share leads
nowhere unless the texts hardly have anything else. Each content that several sets hold among their first is a subtree.

1. Equal sets are one class, named by its smallest doc_id.
2. Every class is compared with the smallest class that it shares a subtree with, pruned by the bound and verified on the texts.
3. In subtrees that hold several components yet, the others are compared with the subtree's smallest.
4. Subtrees that still hold several components are joined by R-tree, between components only; survivors are verified.

No pair within a component is needed beyond its links, so a group of copies costs one row per document and subtree, not a row
per pair, and its rows are dealt out in slices. Links are exact; nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.session import discard, stage

from .common import WordHashes, grams, mix64, record, shuffle_tasks, texts
from .graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NULL_ID = -(1 << 63)
COORDINATES = 256
LEAF, FAN = 32, 8
SLICE = 256  # comparisons of one class beyond which they are dealt out
BLOCK = 2048  # classes of a subtree that one task joins with as many others

SPARE = 5  # ranges: a fourth more than a set of the size class may differ in, so that common contents can be passed over

SETS = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("k", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("keys", "next", "least"))]
)
POINTS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("point", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when 100 * intersection >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    def reach(self, n: int) -> int:
        """Most shingles in which a set of ``n`` can differ from one it links with."""
        m = 100 * n // self.percent
        return (100 - self.percent) * (n + m) // (100 + self.percent)

    def linked(self, n: int, m: int, both: int) -> bool:
        return 100 * both >= self.percent * (n + m - both)


def shingle_sets(batch: pa.RecordBatch, rule: Rule, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, a text without words has none."""
    flat, ends = hashes.of([t.translate(LOWER) for t in texts(batch)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        out.append(np.unique(grams(flat[a:b], min(rule.words, b - a))) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def contents(x: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contents of the filled ranges of a set: in its size class, in the next one if a larger partner may be there, and its smallest shingles.

    Sizes fall into classes of a factor of two, each with its own ranges. The smallest shingles are given if in some class no more
    ranges are filled than the set may differ in; a set that no other can be linked with has nothing.
    """
    n, k = len(x), rule.reach(len(x))
    out = [np.zeros(0, dtype=np.uint64) for _ in range(3)]
    if k:
        c = n.bit_length()
        for i, at in enumerate((c, c + 1) if 100 * n // rule.percent >= 1 << c else (c,)):
            ranges = (rule.reach((1 << at) - 1) + 1) * SPARE // (SPARE - 1)
            g = (x >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            content = np.add.reduceat(mix64(x), starts)
            out[i] = mix64(content ^ mix64(g[starts] * np.uint64(64) + np.uint64(at)))
            if len(starts) <= k:
                out[2] = mix64(x[: n - -(-rule.percent * n // 100) + 1] ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(out)


def count_vector(x: np.ndarray) -> np.ndarray:
    return np.bincount((x & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)


class CountTree:
    """R-tree over count vectors: leaves of LEAF points, FAN nodes to a parent; a node keeps its upper corner and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.leaves = self._tile(np.argsort(sizes, kind="stable"))
        level = [(points[o].max(axis=0), int(sizes[o].min()), int(sizes[o].max()), o) for o in self.leaves]
        self.levels = [level]
        while len(level) > 1:
            packs = [level[i : i + FAN] for i in range(0, len(level), FAN)]
            level = [(np.max([x[0] for x in p], axis=0), min(x[1] for x in p), max(x[2] for x in p), p) for p in packs]
            self.levels.append(level)
        self.root = level[0]

    def _tile(self, order: np.ndarray) -> list[np.ndarray]:
        """Halves along the coordinate (or size) that spreads most, down to a leaf."""
        if len(order) <= LEAF:
            return [order]
        own = self.points[order]
        spread = own.max(axis=0) - own.min(axis=0)
        by = own[:, int(np.argmax(spread))] if int(spread.max()) * 4 > int(np.ptp(self.sizes[order])) else self.sizes[order]
        order = order[np.argsort(by, kind="stable")]
        half = -(-len(order) // (2 * LEAF)) * LEAF
        return [*self._tile(order[:half]), *self._tile(order[half:])]

    def join(self, other: CountTree, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of point numbers whose bound admits a link."""
        p = rule.percent
        stack = [(self.root, other.root)]
        while stack:
            a, b = stack.pop()
            if 100 * a[2] < p * b[1] or 100 * b[2] < p * a[1]:
                continue
            if (100 + p) * int(np.minimum(a[0], b[0]).sum()) < p * (a[1] + b[1]):
                continue
            inner_a, inner_b = isinstance(a[3], list), isinstance(b[3], list)
            if inner_a and (not inner_b or a[2] >= b[2]):
                stack += [(x, b) for x in a[3]]
            elif inner_b:
                stack += [(a, x) for x in b[3]]
            else:
                i, j = a[3], b[3]
                bound = np.minimum(self.points[i][:, None], other.points[j][None]).sum(axis=2)
                x, y = np.nonzero((100 + p) * bound >= p * (self.sizes[i][:, None] + other.sizes[j][None]))
                yield i[x], j[y]


def _set_batches(batches, rule: Rule):
    hashes, other = WordHashes(), np.uint64(0xD1B54A32D192ED03)
    for batch in batches:
        own = shingle_sets(batch, rule, hashes)
        s1, s2 = ([int(mix64(x ^ salt).sum().view(np.int64)) for x in own] for salt in (np.uint64(0), other))
        keys = [contents(x, rule) for x in own]
        lists = []
        for part in range(3):
            flat = [x[part].view(np.int64) for x in keys]
            ends = np.cumsum([0, *map(len, flat)])
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, dtype=np.int64)]))))
        yield record(SETS, batch.column("id"), list(map(len, own)), s1, s2, [rule.reach(len(x)) for x in own], *lists)


def _point_batches(batches, rule: Rule):
    hashes = WordHashes()
    for batch in batches:
        own = shingle_sets(batch, rule, hashes)
        yield record(POINTS, batch.column("id"), list(map(len, own)), [count_vector(x).astype("<i4").tobytes() for x in own])


def _verify_batches(batches, rule: Rule):
    """Rows come sorted by (a, slice), a's own texts first: compare them with each following text."""
    hashes = WordHashes()
    at, own = None, []
    for batch in batches:
        a_out, b_out = [], []
        columns = [batch.column(c).to_pylist() for c in ("a", "slice", "b")]
        for a, part, b, x in zip(*columns, shingle_sets(batch, rule, hashes), strict=True):
            if at != (a, part):
                at, own = (a, part), []
            if b is None:
                if not any(np.array_equal(x, y) for y, _ in own):
                    own.append((x, count_vector(x)))
                continue
            v = count_vector(x)
            for y, w in own:
                n, m = len(x), len(y)
                bound = int(np.minimum(v, w).sum())
                if rule.linked(n, m, min(bound, n, m)) and rule.linked(n, m, len(np.intersect1d(x, y, assume_unique=True))):
                    a_out.append(a)
                    b_out.append(b)
                    break
        yield record(LINKS, a_out, b_out)


def _tree_batches(batches, rule: Rule):
    """Rows come sorted by (key, p, q): join block p with block q, between components. A pair is given in its smallest common subtree."""
    held: list[tuple] = []
    at = None

    def join():
        sides = []
        for side in (0, 1):
            own = [r for r in held if r[0] == side]
            if not own:
                return
            ids, comps, sizes = (np.array([r[k] for r in own], dtype=np.int64) for k in (1, 2, 3))
            points = np.array([np.frombuffer(r[4], dtype="<i4") for r in own], dtype=np.int64)
            sides.append((ids, comps, [set(r[5]) for r in own], CountTree(points, sizes)))
        (ia, ca, ka, ta), (ib, cb, kb, tb) = sides
        for x, y in ta.join(tb, rule):
            here = [i for i in np.flatnonzero(ca[x] != cb[y]).tolist() if min(ka[x[i]] & kb[y[i]]) == at[0]]
            a, b = ia[x[here]], ib[y[here]]
            if len(a):
                yield record(LINKS, np.minimum(a, b), np.maximum(a, b))

    for batch in batches:
        for key, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (key, p, q):
                yield from join()
                at, held = (key, p, q), []
            held.append(row)
    yield from join()


def _verify(pairs: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that link; ``held`` has (id, text) of all classes in them. Texts are fetched in one join for both sides."""
    tasks = shuffle_tasks(pairs.sparkSession)
    slices = F.pow(2, F.greatest(F.lit(0), F.ceil(F.log2(F.col("c") / SLICE)))).cast("int").alias("slices")
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).select("a", slices)
    lead = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("b"))
    follow = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"), "b")
    asked = lead.unionByName(follow).withColumn("id", F.coalesce("b", "a"))
    # sort-merge: the pairs have no size bound
    dealt = held.join(asked.hint("merge"), "id").select("a", "slice", "b", "text")
    dealt = dealt.repartition(tasks, "a", "slice").sortWithinPartitions("a", "slice", F.col("b").isNotNull())
    return dealt.mapInArrow(lambda it: _verify_batches(it, rule), "a long, b long")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """(key, p, q, side, id, comp, n, point, keys): the rows of each subtree in blocks, and the pairs of blocks that hold different components.

    A component of more than BLOCK rows has blocks of its own, which need no comparison among each other.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    pooled = sizes.filter(F.col("m") <= BLOCK).groupBy("key").agg(F.ceil(F.sum("m") / BLOCK).alias("pools"))
    large = sizes.filter(F.col("m") > BLOCK).select("key", "comp", F.ceil(F.col("m") / BLOCK).alias("parts"))
    d = rows.join(large, ["key", "comp"], "left").join(pooled, "key", "left")
    own = F.when(F.col("parts").isNull(), F.struct(F.lit(None).cast("long").alias("c"), F.pmod(F.xxhash64("comp"), "pools").alias("k")))
    d = stage(d.withColumn("block", own.otherwise(F.struct(F.col("comp").alias("c"), F.pmod(F.xxhash64("id"), "parts").alias("k")))).drop("parts", "pools"), "blocks")
    blocks = d.groupBy("key", "block").agg(F.countDistinct("comp").alias("kinds"))
    p, q = blocks.select("key", F.col("block").alias("p"), "kinds"), blocks.select("key", F.col("block").alias("q"))
    pairs = p.join(q, "key").filter((F.col("p") < F.col("q")) & ~(F.col("p.c").isNotNull() & F.col("p.c").eqNullSafe(F.col("q.c"))) | (F.col("p") == F.col("q")) & (F.col("kinds") > 1))
    pairs = pairs.select("key", "p", "q")
    fields = ["key", F.to_json("p").alias("p"), F.to_json("q").alias("q")]
    side = lambda s, c: pairs.join(d.withColumnRenamed("block", c), ["key", c]).select(*fields, F.lit(s).alias("side"), "id", "comp", "n", "point", "keys")
    return side(0, "p").unionByName(side(1, "q"))


def _apart(found: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    """(key, id, comp, centre, centre_id, m): the rows of subtrees (key, id) with several components, the component and id of the smallest class, and the subtree's size."""
    d = found.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    d = stage(d, name)
    least = F.min(F.struct("id", "comp")).alias("least")
    several = d.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), least, F.count(F.lit(1)).alias("m")).filter("x < y")
    several = several.select("key", F.col("least.comp").alias("centre"), F.col("least.id").alias("centre_id"), "m")
    out = stage(d.join(several, "key"), name)
    discard(d)
    return out


def _united(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links; each component stands for its nodes as a star."""
    if links.isEmpty():
        return comps
    return stage(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")


def subtrees(sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(key, rep): the subtrees of each set that is not a copy of another. A set has the k + 1 rarest of its contents in each size class.

    Contents that no other set has lead nowhere, but count among the rarest.
    """
    firsts = sets.filter("k > 0").join(copies, ["id", "s1"], "left_anti")
    # kind, k and number of contents in one long: this table is the largest that is shuffled. Texts of one id that agree in all
    # three are ranked together, which never keeps less than ranking them apart.
    place = lambda c, kind: F.shiftleft(F.lit(kind).cast("long"), 60).bitwiseOR(F.shiftleft("k", 30)).bitwiseOR(F.size(c).cast("long"))
    part = lambda c, kind: F.transform(c, lambda x: F.struct(x.alias("key"), place(c, kind).alias("place")))
    entries = firsts.select("id", F.explode(F.concat(part("keys", 0), part("next", 1), part("least", 2))).alias("e")).select("id", "e.*")
    # each step is staged, so that the shuffle files of the one before are gone: counts, then entries by content, then those found by set
    common = stage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "common")
    # sort-merge: neither side has a size bound, and skewed partitions can be split
    found = stage(entries.join(common.hint("merge"), "key"), "entries")
    discard(common)
    own = W.partitionBy("id", "place")
    nth = F.row_number().over(own.orderBy("held", "key"))
    low = F.lit((1 << 30) - 1).cast("long")
    alone = F.col("place").bitwiseAND(low) - F.count(F.lit(1)).over(own)
    first = found.select("key", F.col("id").alias("rep"), "place", nth.alias("nth"), alone.alias("alone"))
    k, kind = F.shiftright("place", 30).bitwiseAND(low), F.shiftright("place", 60)
    out = stage(first.filter((kind == 2) | (F.col("nth") + F.col("alone") <= k + 1)).select("key", "rep").distinct(), "subtrees")
    discard(found)
    return out


def similar_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id): every row, its set's size and the smallest doc_id that links lead to, itself included.

    Words lie between white space, A-Z lower-cased. Texts with fewer words than a shingle are one shingle; null and empty
    texts, and texts of white space only, have an empty set and link with nothing. Rows that share a doc_id are one node
    with the links of all its texts. A null doc_id is a node smaller than all others, and its component is null. An empty table gives no
    rows; other columns are not read.
    """
    tasks = shuffle_tasks(docs.sparkSession)
    d = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "id long, n long, s1 long, s2 long, k long, keys array<long>, next array<long>, least array<long>"
    sets = stage(d.mapInArrow(lambda it: _set_batches(it, rule), kinds), "sets")
    classes = sets.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    members = stage(sets.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left").select("id", "n", "s1", F.coalesce("rep", "id").alias("rep")), "members")
    copies = stage(members.filter("id <> rep").select("id", "s1").distinct(), "copies")
    buckets = subtrees(sets, copies)
    discard(sets)
    discard(copies)
    centres = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("key", "a")
    star = stage(buckets.join(centres, "key").select("key", F.col("rep").alias("id"), "a"), "stars")
    discard(buckets)
    nearest = stage(star.filter("id > a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    held = stage(d.join(star.select("id").distinct().hint("merge"), "id", "left_semi").distinct(), "texts")
    comps = stage(components(stage(_verify(nearest, held, rule), "links")), "components")
    # subtrees that are not one component yet
    crowd = _apart(star.select("key", "id"), comps, "crowd")
    discard(star)
    others = crowd.filter("comp <> centre").select(F.col("centre_id").alias("a"), F.col("id").alias("b")).distinct()
    others = stage(others.join(nearest, ["a", "b"], "left_anti"), "pairs")
    comps = _united(comps, stage(_verify(others, held, rule), "links"))
    open_ = _apart(crowd.filter("m > 2").select("key", "id"), comps, "open")
    discard(crowd)
    points = held.join(open_.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(lambda it: _point_batches(it, rule), "id long, n int, point binary")
    # the open subtrees of each class: at most as many as it has contents
    rows = open_.select("key", "id", "comp").join(points, "id").join(open_.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    dealt = _block_pairs(rows).repartition(tasks, "key", "p", "q").sortWithinPartitions("key", "p", "q")
    survivors = dealt.mapInArrow(lambda it: _tree_batches(it, rule), "a long, b long").distinct()
    survivors = stage(survivors.join(nearest.unionByName(others), ["a", "b"], "left_anti"), "survivors")
    comps = _united(comps, stage(_verify(survivors, held, rule), "links"))
    for x in (nearest, others, open_, survivors, held):
        discard(x)
    out = members.drop("s1").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
