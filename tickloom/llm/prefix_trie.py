"""Prefix trie over conversations: which turns are shared by which conversations, and what sharing them saves.

Turns are coded by a dictionary, so a conversation is a list of long ids. Equal conversations become one weighted sequence, the
sequences are dealt by range, and every shard builds a ternary search tree: at each depth a binary tree over turn ids, kept balanced
by inserting the median of the sorted sequences first, then the medians of both halves, and so on.

Only prefixes of a shard's first and last sequence can be in other shards, too. All other nodes are finished in their shard. Of the
boundary nodes counts add up over shards; what two neighbours counted twice is the path that the last sequence of one and the
first of the next have in common, and is taken back along that path.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.session import stage

from .common import hash_pair, int_lists, shuffle_tasks

#: Turns of the sequences of one tree; a shard with more builds several.
TREE_TURNS = 500_000
#: Ids joined into one text on the way to a digest.
CHUNK = 1 << 16

NODE = "key binary, parent_key binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_id long"
SHARD = f"{NODE}, first array<long>, last array<long>, last_chars array<int>"
NODE_SCHEMA = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in NODE.split(", ")])
SHARD_SCHEMA = pa.schema([*NODE_SCHEMA, ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("last_chars", pa.list_(pa.int32()))])


class Trie(NamedTuple):
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end_id; ``ends``: end_id, conv_id.

    ``end_id`` names the sequences that end at a node (null: none) by their smallest conversation, and ``ends`` lists them.
    """

    nodes: DataFrame
    ends: DataFrame


def coded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_id, chars): each conversation's turns numbered from 1 and coded by a dictionary of (role, text).

    Order: turn, null first; equal turn numbers by a hash of role and text. A null role or text is empty. Rows without conv_id belong to
    no conversation and take no part. Texts are read once and hashed to 128 bits; they are not shuffled.
    """
    said = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    h1, h2 = hash_pair(*said)
    columns = (F.col("conv_id").cast("long").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"), F.char_length(said[1]).alias("chars"))
    rows = stage(conversations.filter("conv_id IS NOT NULL").select(*columns), "turns")
    words = stage(rows.groupBy("h1", "h2").agg(F.max("chars").alias("chars")).select("h1", "h2", F.monotonically_increasing_id().alias("turn_id")), "words")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "h1", "h2")
    return rows.join(words, ["h1", "h2"]).select("conv_id", F.row_number().over(order).alias("pos"), "turn_id", "chars")


def rebuilt(turns: DataFrame, *, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, ids, chars): each conversation with its first h turns replaced by those of conversation ``conv_id - conv_id % every``.

    h is the unsigned crc32 of the decimal conv_id modulo ``heads``. A conversation may end up without turns and stays.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    turns = stage(turns, "numbered")
    own = turns.withColumn("h", h)
    firsts = turns.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "turn_id", "chars")
    convs = own.groupBy("conv_id").agg(F.max("h").alias("h"))
    taken = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(firsts, "base").filter("pos <= h")
    turn = F.struct("pos", "turn_id", "chars").alias("turn")
    parts = taken.select("conv_id", turn).unionByName(own.filter("pos > h").select("conv_id", turn))
    parts = parts.unionByName(convs.select("conv_id", F.lit(None).cast("struct<pos:int,turn_id:long,chars:int>").alias("turn")))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))  # nulls are not collected
    return whole.select("conv_id", F.col("t.turn_id").alias("ids"), F.col("t.chars").alias("chars"))


class TernaryTree:
    """Ternary search tree with counts. Lists are by node; node 0 is the root of the trie, and a node comes after its parent."""

    def __init__(self) -> None:
        self.turn, self.low, self.down, self.high = [None], [0], [0], [0]  # 0: no such node
        self.parent, self.chars, self.depth = [-1], [0], [0]
        self.n_convs, self.conv_id, self.end_id = [0], [None], [None]

    def _new(self, turn: int, chars: int, parent: int) -> int:
        for column, x in (
            (self.turn, turn), (self.low, 0), (self.down, 0), (self.high, 0), (self.parent, parent), (self.chars, chars),
            (self.depth, self.depth[parent] + 1), (self.n_convs, 0), (self.conv_id, None), (self.end_id, None),
        ):
            column.append(x)
        return len(self.turn) - 1

    def _child(self, v: int, turn: int, chars: int) -> int:
        side, at = self.down, v
        while side[at]:
            at = side[at]
            if turn == self.turn[at]:
                return at
            side = self.low if turn < self.turn[at] else self.high
        side[at] = self._new(turn, chars, v)
        return side[at]

    def insert(self, ids: list[int], chars: list[int], n: int, conv_id: int) -> None:
        """``n`` equal conversations, of which ``conv_id`` is the smallest."""
        v, depth = 0, 0
        while True:
            self.n_convs[v] += n
            if self.conv_id[v] is None or conv_id < self.conv_id[v]:
                self.conv_id[v] = conv_id
            if depth == len(ids):
                break
            v = self._child(v, ids[depth], chars[depth])
            depth += 1
        self.end_id[v] = conv_id

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that was inserted."""
        out = [0]
        for turn in ids:
            out.append(self._child(out[-1], turn, 0))
        return out

    def totals(self) -> tuple[list[int], list[int], list[int]]:
        """(children, leaves, saved) of every node; children are later in the lists, so one way back sees them first."""
        size = len(self.turn)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for v in range(size - 1, -1, -1):
            leaves[v] += children[v] == 0
            saved[v] += (self.n_convs[v] - 1) * self.chars[v]
            if v:
                p = self.parent[v]
                children[p] += 1
                leaves[p] += leaves[v]
                saved[p] += saved[v]
        return children, leaves, saved


def medians_first(n: int) -> Iterator[int]:
    """0 ... n - 1: the median, then the medians of both sides, level by level."""
    level = [(0, n)]
    while level:
        below = []
        for a, b in level:
            if a < b:
                mid = (a + b) // 2
                yield mid
                below += [(a, mid), (mid + 1, b)]
        level = below


def prefix_keys(ids: list[int]) -> list[bytes]:
    """128 bits for each prefix, the empty one first."""
    h = blake2b(digest_size=16)
    out = [h.digest()]
    for turn in ids:
        h.update(turn.to_bytes(8, "little", signed=True))
        out.append(h.digest())
    return out


def tree_batch(rows: list[tuple]) -> pa.RecordBatch:
    """The nodes of a tree over sorted, distinct (ids, chars, n, conv_id), and a row with its first and last sequence."""
    tree = TernaryTree()
    for i in medians_first(len(rows)):
        tree.insert(*rows[i])
    children, leaves, saved = tree.totals()
    size = len(children)
    key = [None] * size
    for ids in (rows[0][0], rows[-1][0]):
        for v, k in zip(tree.path(ids), prefix_keys(ids)):
            key[v] = k
    up = [key[p] if p >= 0 else None for p in tree.parent]
    up_conv = [tree.conv_id[p] if p >= 0 else None for p in tree.parent]
    columns = [key, up, tree.conv_id, up_conv, tree.depth, tree.n_convs, children, leaves, saved, tree.end_id]
    nodes = [pa.array([*c, None], f.type) for c, f in zip(columns, NODE_SCHEMA)]
    ends = [pa.array([*[None] * size, x], SHARD_SCHEMA.field(f).type) for x, f in ((rows[0][0], "first"), (rows[-1][0], "last"), (rows[-1][1], "last_chars"))]
    return pa.RecordBatch.from_arrays([*nodes, *ends], schema=SHARD_SCHEMA)


def shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over sequences that come sorted, a tree for every TREE_TURNS turns."""
    rows, turns = [], 0
    for b in batches:
        for row in zip(int_lists(b.column("ids")), int_lists(b.column("chars")), b.column("n").to_pylist(), b.column("end_id").to_pylist()):
            rows.append(row)
            turns += len(row[0]) + 1
            if turns >= TREE_TURNS:
                yield tree_batch(rows)
                rows, turns = [], 0
    if rows:
        yield tree_batch(rows)


def shared_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring trees counted twice, for every node of the path that the one's last and the other's first sequence share."""
    for b in batches:
        for last, chars, following in zip(int_lists(b.column("last")), int_lists(b.column("last_chars")), int_lists(b.column("following"))):
            same = 0
            while same < min(len(last), len(following)) and last[same] == following[same]:
                same += 1
            again = [*accumulate([0, *chars[:same]][::-1])][::-1]  # code points of a node and of those below it on the path
            size = same + 1
            nothing, ended = [None] * size, [-(same == len(last))] * size  # a sequence that goes on in the next tree is no leaf
            columns = [prefix_keys(last[:same]), nothing, nothing, nothing, nothing, [0] * size, [*[-1] * same, 0], ended, again, nothing]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA)], schema=NODE_SCHEMA)


def prefix_trie(sequences: DataFrame) -> Trie:
    """The trie of (conv_id, ids, chars): one row per distinct prefix, the root included.

    Per node: ``conv_id`` its smallest member, ``depth``, the parent's ``conv_id``, ``n_convs`` members, ``n_children``, ``n_leaves`` childless
    nodes of its subtree and ``saved_tokens``, over its subtree the sum of (members - 1) times the code points of the node's last turn.

    Equal conversations are counted before anything is dealt, so a sequence that a third of all have is one row; a conversation
    without turns ends at the root; conv_ids must be unique and not null (coded_turns and rebuilt see to that). A conversation is
    one row of ids, so its length is bounded by what a row may hold. No conversations give no nodes. Further columns are not read.
    """
    spark = sequences.sparkSession
    sequences = stage(sequences.select("conv_id", "ids", "chars"), "sequences")
    classes = stage(sequences.groupBy("ids", "chars").agg(F.min("conv_id").alias("end_id"), F.count(F.lit(1)).alias("n")), "classes")
    dealt = classes.repartitionByRange(shuffle_tasks(spark), "ids").sortWithinPartitions("ids")
    found = stage(dealt.mapInArrow(shard_batches, SHARD), "trees")

    trees = found.filter("first IS NOT NULL").select("first", "last", "last_chars")
    # one row a tree, two sequences each: a small table
    follow = trees.withColumn("following", F.lead("first").over(Window.orderBy("first"))).filter("following IS NOT NULL")
    twice = follow.select("last", "last_chars", "following").mapInArrow(shared_paths, NODE)
    nodes = found.filter("first IS NULL").drop("first", "last", "last_chars")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    smallest = [F.min(c).alias(c) for c in ("parent_key", "conv_id", "depth", "end_id")]
    border = stage(nodes.filter("key IS NOT NULL").unionByName(twice).groupBy("key").agg(*sums, *smallest), "border")

    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id")
    inner = nodes.filter("key IS NULL")
    below = border.unionByName(inner.filter("parent_key IS NOT NULL").drop("parent_conv_id")).join(parents, "parent_key", "left")
    all_nodes = below.select(*columns).unionByName(inner.filter("parent_key IS NULL").select(*columns))
    ends = sequences.join(classes.select("ids", "end_id"), "ids").select("end_id", "conv_id")
    return Trie(all_nodes, ends)


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end_id, conv_id) as (end_id, first, joined): up to CHUNK decimal ids of one sequence, joined by commas."""
    end_id, ids = None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"end_id": [end_id], "first": [ids[0]], "joined": [",".join(map(str, ids))]})

    for b in batches:
        for e, c in zip(b.column("end_id").to_pylist(), b.column("conv_id").to_pylist()):
            if ids and (e != end_id or len(ids) == CHUNK):
                yield chunk()
                ids = []
            end_id = e
            ids.append(c)
    if ids:
        yield chunk()


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks as (end_id, digest), one chunk in memory at a time."""
    end_id, h = None, None
    for b in batches:
        done = {"end_id": [], "ends_sha256": []}
        for e, joined in zip(b.column("end_id").to_pylist(), b.column("joined").to_pylist()):
            if h is not None and e != end_id:
                done["end_id"].append(end_id)
                done["ends_sha256"].append(h.hexdigest())
                h = None
            if h is None:
                h, end_id = sha256(), e
            else:
                h.update(b",")
            h.update(joined.encode())
        if done["end_id"]:
            yield pa.RecordBatch.from_pydict(done)
    if h is not None:
        yield pa.RecordBatch.from_pydict({"end_id": [end_id], "ends_sha256": [h.hexdigest()]})


def end_digests(ends: DataFrame) -> DataFrame:
    """(end_id, ends_sha256): SHA-256 of the ascending decimal conv_ids of each sequence, joined by commas.

    The ids of a sequence are joined in pieces by as many tasks as its range takes; the pieces then run through the hash in order.
    """
    tasks = shuffle_tasks(ends.sparkSession)
    ends = stage(ends, "ends")
    pieces = ends.repartitionByRange(tasks, "end_id", "conv_id").sortWithinPartitions("end_id", "conv_id")
    pieces = pieces.mapInArrow(chunk_batches, "end_id long, first long, joined string")
    dealt = pieces.repartition(tasks, "end_id").sortWithinPartitions("end_id", "first")
    return dealt.select("end_id", "joined").mapInArrow(digest_batches, "end_id long, ends_sha256 string")
