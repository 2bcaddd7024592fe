"""Passages that repeat across documents, located by Aho-Corasick automata and cut from all but their first document.

1. Anchors. Every window of ``n`` words has an anchor, the smallest hash among its runs of GRAM words, so equal windows
   have equal anchors. About a sixth of the words start an anchor; an aggregate tells which recur in several documents and the first of these.
2. Passages. A run of windows whose recurring anchors share a first document is sent to that document's shard; the first
   document's own run is the passage. Shards with many documents are dealt out in slices, each with a copy of the passage.
3. Automata. A shard compiles the windows of its passages, words as symbols, and streams the runs of the other documents
   through the automaton: a hit is a window of the first document.
4. The rest. Windows with a recurring anchor that are not in that first document are few; they are compared by a 128-bit hash.

Two rows with the same doc_id are one document and never repeat each other. A null doc_id is smaller than all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.session import stage

from .common import WordHashes, grams, record, shuffle_tasks, text_tag, texts

Finish = Callable[[bytes], bytes]

GRAM = 4
SLICE = 256  # documents with an anchor beyond which its shard is dealt out
BLOCK = 200_000  # windows in one automaton
NULL_ID = -(1 << 63)

ANCHORS = pa.schema([("anchor", pa.int64()), ("id", pa.int64())])
RUN = pa.struct([("start", pa.int32()), ("windows", pa.int32()), ("first", pa.int64()), ("bits", pa.int32())])
MARKED = pa.schema([
    ("id", pa.int64()), ("tag", pa.int32()), ("text", pa.string()), ("runs", pa.list_(RUN)), ("n_words", pa.int64()), ("kept", pa.binary()),
])
KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
PASSAGES = pa.schema([
    ("first", pa.int64()), ("bits", pa.int32()), ("slice", pa.int32()), ("follows", pa.bool_()), ("id", pa.int64()), ("tag", pa.int32()),
    ("start", pa.int32()), ("words", pa.binary()),
])
FOUND = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("windows", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    run = "array<struct<start:int,windows:int,first:long,bits:int>>"
    return ", ".join(f"{f.name} {names.get(f.type, run)}" for f in schema)


def window_anchors(hashes: np.ndarray, n: int) -> np.ndarray:
    """Smallest gram hash of each window of ``n`` words, by its start."""
    low = grams(hashes, GRAM)
    width, have = n - GRAM + 1, 1
    while have * 2 <= width:
        low, have = np.minimum(low[: max(0, len(low) - have)], low[have:]), have * 2
    if have < width:
        low = np.minimum(low[: max(0, len(low) - (width - have))], low[width - have :])
    return low


def anchor_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        flat, ends = hashes.of(texts(batch))
        anchors = window_anchors(flat, n)
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)[: len(anchors)]
        # windows inside one text; equal anchors of neighbouring windows once
        keep = np.arange(len(anchors)) + n <= ends[1:][row]
        same = np.concatenate(([False], (anchors[1:] == anchors[:-1]) & (row[1:] == row[:-1])))[: len(anchors)]
        keep &= ~same
        yield record(ANCHORS, anchors[keep].view(np.int64), batch.column("id").to_numpy()[row[keep]])


def mark_batches(batches: Iterator[pa.RecordBatch], n: int, finish: Finish) -> Iterator[pa.RecordBatch]:
    """Runs of windows with a recurring anchor of one first document; a text without any is finished here."""
    hashes = WordHashes()
    for batch in batches:
        out = []
        own_anchors = batch.column("anchors")
        for i, (d, tag, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), texts(batch), strict=True)):
            runs = _runs(own_anchors[i].values, hashes.of([text])[0], n) if own_anchors[i].is_valid else []
            own = text.split() if not runs else []
            out.append((d, tag, text.decode(), runs, None, None) if runs else (d, tag, None, None, len(own), finish(b" ".join(own))))
        if out:
            yield record(MARKED, *zip(*out, strict=True))


def _runs(anchors: pa.StructArray, words: np.ndarray, n: int) -> list[dict]:
    anchor, first, bits = (anchors.field(k).to_numpy() for k in range(3))
    order = np.argsort(anchor)
    anchor, first, bits = anchor[order], first[order], bits[order]
    mine = window_anchors(words, n).view(np.int64)
    at = np.minimum(np.searchsorted(anchor, mine), len(anchor) - 1)
    hit = anchor[at] == mine
    f, b = np.where(hit, first[at], 0), np.where(hit, bits[at], -1)
    cut = np.flatnonzero((f[1:] != f[:-1]) | (b[1:] != b[:-1])) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(mine)]))
    spans = zip(starts.tolist(), stops.tolist(), strict=True)
    return [{"start": s, "windows": e - s, "first": int(f[s]), "bits": int(b[s])} for s, e in spans if e > s and b[s] >= 0]


def passage_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The runs' words, dealt to the slices of their shards; the first document's to every slice."""
    for batch in batches:
        rows = []
        for d, tag, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "tag")), texts(batch), batch.column("runs").to_pylist(), strict=True):
            own = text.split()
            for r in runs:
                slices = 1 << r["bits"]
                follows = d != r["first"]
                cut = b" ".join(own[r["start"] : r["start"] + r["windows"] + n - 1])
                for s in [xxhash.xxh32_intdigest(str(d)) % slices] if follows else range(slices):
                    rows.append((r["first"], r["bits"], s, follows, d, tag, r["start"], cut))
        if rows:
            yield record(PASSAGES, *zip(*rows, strict=True))


class Passages:
    """The windows of some passages, compiled; words are the symbols."""

    def __init__(self, passages: list[list[bytes]], n: int) -> None:
        self.parts: list[tuple[dict[bytes, str], ahocorasick.Automaton]] = []
        for p in passages:
            for a in range(0, len(p) - n + 1, BLOCK):
                part = p[a : a + BLOCK + n - 1]
                if not self.parts or self.room < len(part):
                    self.parts.append(({}, ahocorasick.Automaton()))
                    self.room = 2 * BLOCK
                self.room -= len(part)
                symbol, automaton = self.parts[-1]
                for w in part:
                    if w not in symbol:
                        # the private planes and beyond: no surrogates, 0 stays free
                        symbol[w] = chr(len(symbol) + 1 if len(symbol) < 0xD000 else len(symbol) + 0x3000)
                s = "".join(map(symbol.__getitem__, part))
                for i in range(len(part) - n + 1):
                    automaton.add_word(s[i : i + n], True)
        for _, automaton in self.parts:
            automaton.make_automaton()

    def hits(self, run: list[bytes], n: int) -> np.ndarray:
        """Which windows of the run are windows of the passages."""
        found = np.zeros(len(run) - n + 1, dtype=bool)
        for symbol, automaton in self.parts:
            s = "".join([symbol.get(w, "\0") for w in run])
            found[[end - n + 1 for end, _ in automaton.iter(s)]] = True
        return found


def locate_batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Windows found in a shard's passages (h1 null), and hashes of the other windows, one by one. Rows come sorted by shard, passages first."""
    at, passages, compiled = None, [], None
    for batch in batches:
        rows = []
        for first, bits, part, follows, d, tag, start, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (first, bits, part):
                at, passages, compiled = (first, bits, part), [], None
            run = words.split(b" ")
            if not follows:
                passages.append(run)
                continue
            compiled = compiled or Passages(passages, n)
            hit = compiled.hits(run, n)
            edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
            rows += [(d, tag, start + a, b - a, None, None) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            for i in np.flatnonzero(~hit).tolist():
                h = xxhash.xxh128_intdigest(b" ".join(run[i : i + n]))
                rows.append((d, tag, start + i, 1, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)))
        if rows:
            yield record(FOUND, *zip(*rows, strict=True))


def removed_batches(batches: Iterator[pa.RecordBatch], n: int, finish: Finish) -> Iterator[pa.RecordBatch]:
    """``kept`` is the words outside the found windows, joined by a space."""
    for batch in batches:
        out = []
        for d, text, spans in zip(batch.column("id").to_pylist(), texts(batch), batch.column("spans").to_pylist(), strict=True):
            own = text.split()
            n_words = len(own)
            if spans:
                gone = np.zeros(n_words + 1, dtype=np.int32)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["start"] + s["windows"] + n - 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                own = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            out.append((d, n_words, n_words - len(own), finish(b" ".join(own))))
        if out:
            yield record(KEPT, *zip(*out, strict=True))


def repeated_windows(docs: DataFrame, *, n: int = 13, finish: Finish = bytes) -> tuple[DataFrame, DataFrame]:
    """(marked, spans): every row, finished or with its text and runs; (id, tag, start, windows), the windows that an earlier document holds."""
    spark = docs.sparkSession
    tasks = shuffle_tasks(spark)
    d = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), text_tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    anchors = d.select("id", "text").mapInArrow(lambda it: anchor_batches(it, n), ddl(ANCHORS))
    slices = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SLICE))).cast("int")
    recurring = (
        anchors.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("first < last").select("anchor", "first", slices.alias("bits"))
    )
    per_doc = anchors.join(recurring, "anchor").groupBy(F.col("id").alias("a_id")).agg(F.collect_set(F.struct("anchor", "first", "bits")).alias("anchors"))
    joined = d.join(per_doc, F.col("id") == F.col("a_id"), "left").select("id", "tag", "text", "anchors")
    marked = stage(joined.mapInArrow(lambda it: mark_batches(it, n, finish), ddl(MARKED)), "marked")
    passages = marked.filter("runs IS NOT NULL").select("id", "tag", "text", "runs").mapInArrow(lambda it: passage_batches(it, n), ddl(PASSAGES))
    dealt = passages.repartition(tasks, "first", "bits", "slice").sortWithinPartitions("first", "bits", "slice", "follows")
    found = stage(dealt.mapInArrow(lambda it: locate_batches(it, n), ddl(FOUND)), "located")
    other = found.filter("h1 IS NOT NULL")
    again = other.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    late = other.join(again, ["h1", "h2"]).filter("id > first")
    spans = found.filter("h1 IS NULL").select("id", "tag", "start", "windows").unionByName(late.select("id", "tag", "start", "windows"))
    return marked, spans


def remove_repeats(docs: DataFrame, *, n: int = 13, finish: Finish = bytes) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row; ``kept`` is the text's words without those of repeated windows.

    A word goes if a window of ``n`` consecutive words over it also starts in a document with a smaller doc_id. Null and
    empty texts have no words. An empty table gives no rows; other columns are not read.
    """
    marked, spans = repeated_windows(docs, n=n, finish=finish)
    per_doc = spans.groupBy(F.col("id").alias("s_id"), F.col("tag").alias("s_tag")).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    some = marked.filter("runs IS NOT NULL").select("id", "tag", "text")
    joined = some.join(per_doc, (F.col("id") == F.col("s_id")) & (F.col("tag") == F.col("s_tag")), "left").select("id", "text", "spans")
    out = joined.mapInArrow(lambda it: removed_batches(it, n, finish), ddl(KEPT))
    none = marked.filter("runs IS NULL").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return out.unionByName(none).select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
