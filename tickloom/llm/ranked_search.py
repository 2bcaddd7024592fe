"""Ranked lexical search over a length-stratified index, in integer arithmetic.

A document of n terms has the normaliser m = 100 - b + ((b * n * N) div L), so documents of about the same length share m. All
documents of one m are a stratum; it is stored in blocks, and in a block the postings of a term are grouped by tf. With m and tf
given, a term's impact is one number for the whole group: it is computed once per tf, never per posting.

A stratum's bound for an item is the sum over its terms of the impact at the stratum's largest tf. Strata are visited in order of
their bounds: the first visits give each item its k-th best score so far, a floor; then only blocks whose bound reaches it are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tickloom.session import stage

from .common import LOWER_BYTES, shuffle_tasks, texts

# fixed values of the score
K_SCALE, K1, B_SHARE, TF_SCALE, WEIGHT_SCALE = 1_000_000_000, 20, 50, 1000, 1000
#: Maximal runs outside ASCII controls and punctuation, in UTF-8: ASCII letters and digits, and every byte of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: Distinct terms of its documents that a block holds, so that a block stays a small row (one document may hold more).
BLOCK_POSTINGS = 200_000
#: Items searched in one pass, and terms that they may hold together; further items go to further passes.
PASS_ITEMS, PASS_TERMS = 512, 65_536
#: The first visits go to the best strata of an item until these hold so many times k documents with a term of the item.
FIRST_VISITS = 4

FORWARD = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
BLOCKS = pa.schema(
    [
        ("m", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
        ("term_ends", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("tf_ends", pa.list_(pa.int32())), ("members", pa.list_(pa.int32())),
    ]
)


class Index(NamedTuple):
    """``blocks``: a row per block (m, docs, terms, term_ends, tfs, tf_ends, members).

    Groups of equal tf ``term_ends[t - 1] : term_ends[t]`` belong to term t, and members ``tf_ends[g - 1] : tf_ends[g]`` (places in
    ``docs``) to group g. ``n_docs`` counts documents with a term, ``n_terms`` their terms.
    """

    blocks: DataFrame
    n_docs: int
    n_terms: int


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.translate(LOWER_BYTES))


def forward_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each document that has some, with their tf."""
    for b in batches:
        ids, n, terms, tfs, ends = [], [], [], [], [0]
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b)):
            found = terms_of(text)
            if found:
                counts = Counter(found)
                ids.append(doc_id)
                n.append(len(found))
                terms += counts.keys()
                tfs += counts.values()
                ends.append(len(terms))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), _lists(ends, pa.array(terms, pa.binary()).cast(pa.string())), _lists(ends, pa.array(tfs, pa.int32()))], schema=FORWARD
        )


def _lists(ends, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _one(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.ListArray:
    """A list column of one row."""
    return _lists([0, len(values)], values if isinstance(values, pa.Array) else pa.array(values, kind))


def invert(m: int, docs: pa.Array, terms: pa.Array, owners: np.ndarray, tfs: np.ndarray) -> pa.RecordBatch:
    """A block of documents of one stratum: their (term, owner, tf) triples grouped by term, then by tf."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.lexsort((owners, tfs, code))
    code, tfs, owners = code[order], tfs[order], owners[order]
    new_term = np.flatnonzero(np.diff(code, prepend=-1))
    new_group = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(tfs, prepend=-1) != 0))
    tf_ends = np.append(new_group[1:], len(code))
    term_ends = np.append(np.searchsorted(new_group, new_term[1:]), len(new_group))
    columns = (_one(term_ends, pa.int32()), _one(tfs[new_group], pa.int32()), _one(tf_ends, pa.int32()), _one(owners, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), _one(docs, pa.int64()), _one(coded.dictionary, pa.string()), *columns], schema=BLOCKS)


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted by m. A block ends with its stratum, with the batch or when it is full."""
    for b in batches:
        if not b.num_rows:
            continue
        m = b.column("m").to_numpy()
        sizes = b.column("terms").value_lengths().to_numpy()
        before = np.concatenate([[0], np.cumsum(sizes)])
        terms, tfs = b.column("terms").flatten(), b.column("tfs").flatten().to_numpy()
        i = 0
        while i < len(m):
            full = np.searchsorted(before, before[i] + BLOCK_POSTINGS, side="right") - 1
            j = int(min(max(full, i + 1), np.searchsorted(m, m[i], side="right")))
            part = slice(before[i], before[j])
            owners = np.repeat(np.arange(j - i, dtype=np.int32), sizes[i:j])
            yield invert(int(m[i]), b.column("doc_id")[i:j], terms[part], owners, tfs[part])
            i = j


def build_index(docs: DataFrame) -> Index:
    """The index of all rows of ``docs`` that have a term; written to the shared folder.

    A null or empty text, or one without terms, has no entry and counts nowhere. Null and repeated ids are documents of their own, a very
    long text is one block if it must; an empty table gives an empty index. Further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    forward = stage(rows.mapInArrow(forward_batches, "doc_id long, n long, terms array<string>, tfs array<int>"), "forward")
    n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    forward = forward.withColumn("m", F.expr(f"100 - {B_SHARE} + (({B_SHARE} * n * {n_docs}) div {max(n_terms, 1)})"))
    # a stratum may hold any share of the documents: it is cut into slices by the postings it has, one row a stratum tells how many
    slices = stage(forward.groupBy("m").agg(F.ceil(F.sum(F.size("terms")) / BLOCK_POSTINGS).alias("slices")), "slices")
    # by row number, so that repeated rows part, too; the staged files give a row the same number each time
    numbered = forward.withColumn("number", F.xxhash64(F.monotonically_increasing_id()))
    dealt = numbered.join(slices, "m").withColumn("slice", F.pmod("number", F.col("slices")))
    dealt = dealt.repartition(shuffle_tasks(docs.sparkSession), "m", "slice").sortWithinPartitions("m", "slice")
    sorted_rows = dealt.select("doc_id", "m", "terms", "tfs")
    kinds = "m long, docs array<long>, terms array<string>, term_ends array<int>, tfs array<int>, tf_ends array<int>, members array<int>"
    return Index(stage(sorted_rows.mapInArrow(block_batches, kinds), "blocks"), n_docs, n_terms)


def impact(weight, tf, m):
    """A term's share of the score; for numbers, arrays and columns."""
    if isinstance(tf, Column):
        return weight * F.expr(f"({K_SCALE} * tf) div ({TF_SCALE} * tf + {K1} * m)")
    return weight * (K_SCALE * tf // (TF_SCALE * tf + K1 * m))


class Items(NamedTuple):
    """Items of one pass: places of their terms in ``vocabulary``."""

    keys: list
    vocabulary: list[str]
    terms: list[list[int]]


def passes(items: Iterator[Row]) -> Iterator[Items]:
    """Items in passes of at most PASS_ITEMS items and about PASS_TERMS terms, so that what a pass broadcasts is bounded."""
    keys, vocabulary, terms = [], {}, []
    for key, text in items:
        own = {t.decode() for t in terms_of((text or "").encode())}
        keys.append(key)
        terms.append(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in own))
        if len(keys) == PASS_ITEMS or len(vocabulary) >= PASS_TERMS:
            yield Items(keys, list(vocabulary), terms)
            keys, vocabulary, terms = [], {}, []
    if keys:
        yield Items(keys, list(vocabulary), terms)


def _blocks(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each with its lists as arrays; only the columns that the batch has."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            v = batch.column(name)[i]
            row[name] = v.as_py() if name == "m" else v.values if name in ("terms", "docs") else v.values.to_numpy()
        yield row


def _known(block: dict, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, places in the vocabulary) of the block's terms that the vocabulary has."""
    codes = pc.index_in(block["terms"], value_set=vocabulary).fill_null(-1).to_numpy()
    places = np.flatnonzero(codes >= 0)
    return places, codes[places]


def block_terms(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(m, term, df, tf): the documents of a block that hold a term of the items, and its largest tf there."""
    vocabulary = pa.array(items.vocabulary, pa.string())
    for b in batches:
        for block in _blocks(b):
            places, codes = _known(block, vocabulary)
            groups = np.append(0, block["term_ends"])
            ends = np.append(0, block["tf_ends"])
            df = ends[groups[places + 1]] - ends[groups[places]]
            columns = (np.full(len(places), block["m"]), codes, df, block["tfs"][groups[places + 1] - 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["m", "term", "df", "tf"])


def score_blocks(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, first: dict[int, list[int]], floors: np.ndarray | None, k: int):
    """(item, doc_id, score): the k best documents of each block for each item that visits it.

    Without ``floors`` the visits are those of ``first`` (m -> items). With them they are all others where the block's bound reaches the
    item's floor, and only scores that reach it come out.
    """
    vocabulary = pa.array(items.vocabulary, pa.string())
    flat = np.array([t for own in items.terms for t in own], dtype=np.int64)
    owner = np.repeat(np.arange(len(items.terms)), [len(own) for own in items.terms])
    for b in batches:
        for block in _blocks(b):
            m, docs = block["m"], block["docs"]
            groups, ends = np.append(0, block["term_ends"]), np.append(0, block["tf_ends"])
            places, codes = _known(block, vocabulary)
            at = dict(zip(codes.tolist(), places.tolist()))
            if floors is None:
                visits = first.get(m, [])
            else:
                most = np.zeros(len(weights), dtype=np.int64)
                most[codes] = impact(weights[codes], block["tfs"][groups[places + 1] - 1].astype(np.int64), m)
                bounds = np.zeros(len(items.terms), dtype=np.int64)
                np.add.at(bounds, owner, most[flat])
                bounds[first.get(m, [])] = 0
                visits = np.flatnonzero((bounds > 0) & (bounds >= floors)).tolist()
            if not visits:
                continue
            ids, no_id = docs.fill_null(0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False)
            shares: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def share(term: int) -> tuple[np.ndarray, np.ndarray]:
                """Members of a term's postings and what each adds: the impact of a tf, computed once and repeated for its group."""
                if term not in shares:
                    g = slice(groups[at[term]], groups[at[term] + 1])
                    each = impact(weights[term], block["tfs"][g].astype(np.int64), m)
                    shares[term] = block["members"][ends[g.start] : ends[g.stop]], np.repeat(each, np.diff(ends[g.start : g.stop + 1]))
                return shares[term]

            found, ranks, scores = [], [], []
            for item in visits:
                score = np.zeros(len(docs), dtype=np.int64)
                for term in items.terms[item]:
                    if term in at:
                        members, adds = share(term)
                        score[members] += adds  # a term has a document in one group only
                best = np.flatnonzero(score >= (1 if floors is None else max(floors[item], 1)))
                if len(best) > k:
                    best = best[np.lexsort((ids[best], no_id[best], -score[best]))[:k]]
                found += [item] * len(best)
                ranks.append(best)
                scores.append(score[best])
            columns = [pa.array(found, pa.int32()), docs.take(pa.array(np.concatenate(ranks))), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])


def search_pass(index: Index, items: Items, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one pass; ``item`` is the place in the pass."""
    spark = index.blocks.sparkSession
    known = index.blocks.select("m", "terms", "term_ends", "tfs", "tf_ends").mapInArrow(lambda it: block_terms(it, items), "m long, term long, df long, tf long")
    strata = stage(known.groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("tf").alias("tf")), "strata")
    df = dict(strata.groupBy("term").agg(F.sum("df")).collect())  # at most as many rows as the pass has terms
    weights = np.array([floor(WEIGHT_SCALE * log((2 * index.n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(items.vocabulary))], dtype=np.int64)

    asked = spark.createDataFrame([(i, t, int(weights[t])) for i, own in enumerate(items.terms) for t in own], "item int, term long, weight long")
    bounds = strata.join(F.broadcast(asked), "term").groupBy("item", "m").agg(
        F.sum(impact(F.col("weight"), F.col("tf"), F.col("m"))).alias("bound"), F.max("df").alias("df")
    )
    # the best strata until they hold enough documents that surely score; at most FIRST_VISITS * k strata an item
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    begun = bounds.filter("bound > 0").withColumn("before", F.coalesce(F.sum("df").over(by_bound), F.lit(0)))
    first: dict[int, list[int]] = {}
    for m, item in begun.filter(F.col("before") < FIRST_VISITS * k).select("m", "item").collect():
        first.setdefault(m, []).append(item)

    def scored(blocks: DataFrame, floors: np.ndarray | None) -> DataFrame:
        rows = blocks.mapInArrow(lambda it: score_blocks(it, items, weights, first, floors, k), "item int, doc_id long, score long")
        return stage(rows, "scores")

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    begin = spark.createDataFrame([(m,) for m in first], "m long")
    one = scored(index.blocks.join(F.broadcast(begin), "m", "left_semi"), None)
    floors = np.ones(len(items.keys), dtype=np.int64)
    for item, score in best(one).filter(F.col("rank") == k).select("item", "score").collect():  # one row an item at most
        floors[item] = score
    return best(one.unionByName(scored(index.blocks, floors)))


def search(index: Index, items: DataFrame, *, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row (item_id, text) of ``items`` with a score above 0.

    Equal scores are ranked by doc_id, null ids last. Null and repeated item ids are items of their own; an item without terms, or whose
    terms no document has, gets no rows. Repeated documents are ranked each. Items go in passes of bounded size over all documents.
    """
    found = None
    for part in passes(items.select("item_id", "text").sort("item_id", "text").toLocalIterator()):
        keys = index.blocks.sparkSession.createDataFrame(list(enumerate(part.keys)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        one = search_pass(index, part, k).join(F.broadcast(keys), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = one if found is None else found.unionByName(one)
    if found is None:
        empty = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
        return index.blocks.sparkSession.createDataFrame([], empty)
    return found
