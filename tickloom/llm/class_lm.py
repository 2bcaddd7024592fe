"""Class-based bigram language model: words in classes found by exchange, P(word | before) = P(class | class before) * P(word | class).

Counts of all words and of all neighbouring pairs come from all training documents. All words seen ``least`` times are clustered
by exchange: each round counts every word's neighbours by class, and words move to the class that raises the likelihood most.
Words above a share of all tokens make the first classes by themselves; then the others, begun in classes by their last bytes, take
part and all go on until few move. Words lie in shards by hash, and pairs in chunks by the shards of both words, as arrays: a round reads the chunks
with the classes of two shards each, and shuffles sums by word and class only. Words seen less often stay in the class of their last bytes.
The most frequent words, up to a bound, are resolved by a broadcast table of hashes; the others' counts and classes come by a join.
Pairs move as arrays, too: each batch of texts sums up its own, and those of a pair of shards are summed where they meet.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.session import discard, stage

from .common import LOWER_BYTES, SPACE_CHARS, WordHashes, record, texts

END = b""  # closes every text; no word is empty
SHARD, SHARDS = 1 << 16, 256  # words of a shard, as long as there are no more than so many shards
SUB = 1 << 13  # words of a shard whose neighbours one task sums up
CHUNK = 1 << 16  # pairs of a row
SLICE = 1 << 19  # pairs that one task sums up at once, as far as their number is known before
AT_ONCE = 256  # words whose moves are weighed at once
PIECE = 1 << 21  # bytes of text whose words are hashed at once
PHASE = 12  # bits of a class; the phase of its word lies above
SYMBOL = 1 << 62  # from here on, symbols of words that have no number yet
COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
DEALT = pa.schema([*((c, pa.int32()) for c in ("sa", "sub", "sb", "slice")), *((c, pa.binary()) for c in ("la", "lb", "n"))])
DEALT_SCHEMA = "sa int, sub int, sb int, slice int, la binary, lb binary, n binary"
PAIRS = pa.schema([*DEALT, *((c, pa.int64()) for c in ("a", "b", "k"))])
CHUNKS = pa.schema([("sa", pa.int32()), ("sub", pa.int32()), ("sb", pa.int32()), *((c, pa.binary()) for c in ("a", "b", "n"))])
CLASSES = pa.schema([("shard", pa.int32()), ("of", pa.binary()), ("moved", pa.int64())])
NEAR = pa.schema([("shard", pa.int32()), ("sub", pa.int32()), *((c, pa.binary()) for c in ("own", "codes", "n")), ("m", pa.list_(pa.int64()))])
MOVES = pa.schema([("shard", pa.int32()), ("ids", pa.binary()), ("to", pa.binary())])
NAMED = pa.schema([("id", pa.int64()), ("c", pa.int32())])
RARE = pa.struct([("word", pa.binary()), ("at", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])
SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(RARE)),
])
FOUND = pa.schema([("row", pa.int64()), ("known", pa.int64()), ("counted", pa.float64()), ("more", pa.float64())])


@dataclass(frozen=True)
class Settings:
    """``classes`` by exchange and ``tails`` (at most 256) by last bytes, together below 4,096; words seen ``least`` times or with one token in ``cluster`` are
    clustered. The latter make the first classes; then all move between all classes, the others from their tail class. Both go on until under
    ``delta`` of them do in three rounds or the likelihood no longer rises. The most frequent words, at most ``lookup`` and the end of a text, are resolved without a
    join. ``pull`` is the weight of a class's own share in its transitions."""

    classes: int = 64
    tails: int = 32
    cluster: int = 8192
    lookup: int = 1 << 20
    pull: float = 10.0
    least: int = 5
    delta: float = 0.02


class Lookup:
    """Places of 64-bit hashes in ``keys``, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.concatenate([keys, np.zeros(1, dtype=np.uint64)])  # the last one is read for an empty slot
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slots(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for a hash that is not among the keys."""
        at = self._slots(hashes)
        out = self.table[at]
        some = np.flatnonzero((out >= 0) & (self.keys[out] != hashes))
        at = at[some]
        while len(some):
            at = at + 1 & self.mask
            got = self.table[at]
            out[some] = got
            on = (got >= 0) & (self.keys[got] != hashes[some])
            some, at = some[on], at[on]
        return out


@dataclass
class Often:
    """The most frequent words by hash, in the order of ``lookup``; the end of a text comes after them, in the last place of ``n`` and ``c``."""

    lookup: Lookup
    id: np.ndarray  # number of the word, or of its tail class
    n: np.ndarray
    c: np.ndarray = field(default=None)  # classes, known once the exchange is over

    @property
    def end(self) -> int:
        return len(self.n) - 1

    def places(self, batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
        """(row, texts, places, ends) of pieces of a batch: the place of each word, -1 for one that is not here, and of the end that follows
        each text; where each text's end stands."""
        hashes, held, size, row = WordHashes(), [], 0, 0
        for i, t in enumerate(low := [t.translate(LOWER_BYTES) for t in texts(batch)]):
            held.append(t)
            size += len(t) + 1
            if size >= PIECE or i + 1 == len(low):
                flat, begins = hashes.of(held)
                ends = begins[1:] + np.arange(len(held))
                out = np.full(len(flat) + len(held), self.end, dtype=np.int64)
                word = np.ones(len(out), dtype=bool)
                word[ends] = False
                out[word] = self.lookup.find(flat)
                yield row, held, out, ends
                held, size, row = [], 0, i + 1


def not_found(held: list[bytes], places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(where, words, text, place in it) of the words that have no place."""
    where = np.flatnonzero(places < 0)
    of = np.searchsorted(ends, where)
    at = where - np.concatenate([[0], ends[:-1] + 1])[of]
    words, last, own = [], -1, []
    for t, i in zip(of.tolist(), at.tolist(), strict=True):
        if t != last:
            last, own = t, held[t].split()
        words.append(own[i])
    return where, words, of, at


@dataclass
class Model:
    settings: Settings
    tokens: int
    distinct: int
    often: Often
    least: int  # count from which words are in ``often``
    step: np.ndarray = field(default=None)  # log10 P(class | class before)
    mass: np.ndarray = field(default=None)  # log10 of a class's tokens + distinct words + 1
    lexicon: DataFrame = field(default=None)  # (word, n, c) of all words; stays on the driver

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lexicon": None, "rest_": None}

    def class_of(self, word: bytes) -> int:
        """For a look at the model on the driver, where the first word fetches the classes that are not tail classes; scoring joins them."""
        if self.__dict__.get("rest_") is None and self.lexicon is not None:
            self.rest_ = {bytes(w): c for w, c in self.lexicon.filter(F.col("c") != tail_column(self.settings)).select("word", "c").toLocalIterator()}
        c = 0 if word == END else (self.rest_ or {}).get(word)
        return tail_class(word, self.settings) if c is None else c


def tail_class(word: bytes, settings: Settings) -> int:
    return settings.classes + zlib.crc32(word[-2:]) % settings.tails


def tail_column(settings: Settings) -> Column:
    return F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(settings.tails)).cast("int") + settings.classes


def symbol(word: bytes, settings: Settings) -> int:
    """Symbol of a word that is not among the most frequent: 54 bits of a hash and the tail class."""
    return SYMBOL + (int.from_bytes(hashlib.md5(word).digest()[:7], "big") >> 2) * settings.tails + zlib.crc32(word[-2:]) % settings.tails


def symbol_column(settings: Settings) -> Column:
    bits = F.shiftright(F.conv(F.substring(F.md5("word"), 1, 14), 16, 10).cast("long"), 2)
    return bits * settings.tails + (tail_column(settings) - settings.classes) + SYMBOL


def pieces(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """Texts of a batch, about PIECE bytes at a time."""
    held, size = [], 0
    for t in texts(batch):
        held.append(t)
        size += len(t) + 1
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_array(held: list[bytes]) -> pa.Array:
    """The words of all texts in a row, without a Python object for each."""
    data = np.frombuffer(b" " + b" ".join(held).translate(LOWER_BYTES) + b" ", dtype=np.uint8)
    space = np.isin(np.arange(256), list(SPACE_CHARS.encode()))[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    ends = np.append(0, np.cumsum(edges[1::2] - edges[::2])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[~space])])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.chunked_array(map(word_array, pieces(batch)), pa.binary()).value_counts()
        yield record(COUNTS, t.field("values"), t.field("counts"))
        yield record(COUNTS, [END], [batch.num_rows])


def pair_batches(batches: Iterator[pa.RecordBatch], often: Often, settings: Settings, joins: bool, shards: int, slices: int) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring words, by their numbers in ``often``, as ``dealt`` rows. Other words are their tail class; with ``joins`` they are
    symbols, whose pairs are rows (a, b, k) by themselves."""
    own = [] if joins else [-1 - t for t in range(settings.tails)]
    for batch in batches:
        found, new, names = [np.array([often.end], dtype=np.int32)], {}, list(own)
        for _, held, places, ends in often.places(batch):
            where, words, _, _ = not_found(held, places, ends)
            if joins:
                for w in words:
                    if w not in new:
                        new[w] = len(often.n) + len(new)
                        names.append(symbol(w, settings))
                places[where] = [new[w] for w in words]
            else:
                places[where] = [len(often.n) + zlib.crc32(w[-2:]) % settings.tails for w in words]
            found.append(places.astype(np.int32))
        x = np.concatenate(found)
        code = x[:-1].astype(np.int64) << 32
        code |= x[1:]
        del found, x
        code.sort()
        edges = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        code, n = code[edges[:-1]], np.diff(edges)
        number = np.concatenate([often.id, np.array(names, dtype=np.int64)])
        a, b = number[code >> 32], number[code & 0xFFFFFFFF]
        del code, edges
        above = (a >= SYMBOL) | (b >= SYMBOL)
        if above.any():
            none = [pa.nulls(int(above.sum()), f.type) for f in DEALT]
            yield record(PAIRS, *none, a[above], b[above], n[above])
            a, b, n = a[~above], b[~above], n[~above]
        yield from (record(PAIRS, *r.columns, *(pa.nulls(r.num_rows, pa.int64()) for _ in "abk")) for r in dealt(a, b, n, shards, slices))


def deal_batches(batches: Iterator[pa.RecordBatch], shards: int, slices: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, k) of resolved pairs as ``dealt`` rows."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b", "k")])
        size += batch.num_rows
        if size >= 2 * SLICE:
            yield from dealt(*map(np.concatenate, zip(*held, strict=True)), shards, slices)
            held, size = [], 0
    if held:
        yield from dealt(*map(np.concatenate, zip(*held, strict=True)), shards, slices)


def dealt(a: np.ndarray, b: np.ndarray, n: np.ndarray, shards: int, slices: int) -> Iterator[pa.RecordBatch]:
    """Pairs of numbered words, and how often each occurs, as arrays: one row for each pair of shards, part of the first and slice of that part.
    Tail classes are the shard after the last."""
    if not len(a):
        return
    (sa, la), (sb, lb) = ((np.where(x >= 0, x >> 32, shards).astype(np.int32), np.where(x >= 0, x, -1 - x).astype(np.uint32)) for x in (a, b))  # the lower 32 bits
    sub = (la // SUB).astype(np.int32)
    la %= SUB
    cut = (la % slices).astype(np.int32)
    key = sa.astype(np.int64)
    for x, width in ((sub, int(sub.max()) + 1), (sb, shards + 1), (cut, slices)):
        key *= width
        key += x
    # numbers of 16 bits are sorted in linear time
    order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    first = order[edges[:-1]]
    arrays = (x[order].astype(t) for x, t in ((la, "<u2"), (lb, "<u4"), (n, "<i8")))
    blobs = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in arrays]
    yield record(DEALT, *(x[first] for x in (sa, sub, sb, cut)), *blobs)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class Gains:
    """What moves add to the likelihood of a matrix of class counts."""

    def __init__(self, matrix: np.ndarray, classes: int) -> None:
        self.classes = classes
        # by rows and by columns, so that both kinds of neighbours are gathered as rows
        self.m, self.t = matrix, np.ascontiguousarray(matrix.T)
        self.f, self.ft = xlogx(self.m), xlogx(self.t)
        self.r, self.k = matrix.sum(axis=1), matrix.sum(axis=0)

    def _side(self, m: np.ndarray, f: np.ndarray, own: int, near: np.ndarray, back: np.ndarray, self_: float) -> np.ndarray:
        """For each class: the gain by neighbours ``near`` (rows of ``m``), once the word and its neighbours ``back`` on the other side have left ``own``."""
        some = np.flatnonzero(near)
        x, was, add = m[some, : self.classes], f[some, : self.classes], near[some, None]
        if own < self.classes:
            x[:, own] -= near[some]
        p = np.flatnonzero(some == own)
        if len(p):
            x[p] -= back[: self.classes]
            if own < self.classes:
                x[p, own] -= self_
            was[p] = xlogx(x[p])
        if own < self.classes:
            was[:, own] = xlogx(x[:, own])
        x += add  # one at least
        return np.einsum("ij,ij->j", x, np.log(x)) - was.sum(axis=0)

    def best(self, own: int, side: np.ndarray, c: np.ndarray, n: np.ndarray) -> int:
        """The class that raises the likelihood most, of a word with ``n`` neighbours in ``c`` after (side 1) or before it (0); side 2: pairs
        of the word with itself."""
        size = len(self.m)
        right, left = (np.bincount(c[side == s], n[side == s], size) for s in (1, 0))
        self_ = float(n[side == 2].sum())
        n_right, n_left = right.sum() + self_, left.sum() + self_
        r, k, d = self.r.copy(), self.k.copy(), self.m.diagonal().copy()
        # what leaves the word's class leaves its row and column, and no other's sums
        r[own] -= n_right
        k[own] -= n_left
        d[own] -= right[own] + left[own] + self_
        gain = self._side(self.t, self.ft, own, right, left, self_) + self._side(self.m, self.f, own, left, right, self_)
        b = slice(0, self.classes)
        r, k, d, right, left = r[b], k[b], d[b], right[b], left[b]
        gain += xlogx(d + right + left + self_) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
        gain -= xlogx(r + n_right) - xlogx(r) + xlogx(k + n_left) - xlogx(k)
        to = int(np.argmax(gain))
        return to if gain[to] > gain[own] + 1e-6 else own


    def bests(self, own: np.ndarray, word: np.ndarray, side: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``best`` for many words at once: ``own`` classes of the words, and rows (word, side, class, count), at most one of a word, side and class."""
        size, k, rows = len(self.m), self.classes, np.arange(len(own))
        near = np.zeros((2, len(own), size))  # before, after
        both = side < 2
        near[side[both], word[both], c[both]] = n[both]
        left, right = near
        self_ = np.bincount(word[~both], n[~both], len(own))
        n_right, n_left = right.sum(axis=1) + self_, left.sum(axis=1) + self_
        gain = self._sides(self.t, self.ft, own, right, left, self_) + self._sides(self.m, self.f, own, left, right, self_)
        r, q, d = (np.repeat(x[None], len(own), axis=0) for x in (self.r, self.k, self.m.diagonal()))
        r[rows, own] -= n_right
        q[rows, own] -= n_left
        d[rows, own] -= right[rows, own] + left[rows, own] + self_
        r, q, d, right, left = (x[:, :k] for x in (r, q, d, right, left))
        self_, n_right, n_left = self_[:, None], n_right[:, None], n_left[:, None]
        gain += xlogx(d + right + left + self_) - xlogx(d + right) - xlogx(d + left) + xlogx(d)
        gain -= xlogx(r + n_right) - xlogx(r) + xlogx(q + n_left) - xlogx(q)
        to = gain.argmax(axis=1)
        # no gain is known for a class that words can't move to
        return np.where(gain[rows, to] > np.where(own < k, gain[rows, np.minimum(own, k - 1)], np.inf) + 1e-6, to, own)

    def _sides(self, m: np.ndarray, f: np.ndarray, own: np.ndarray, near: np.ndarray, back: np.ndarray, self_: np.ndarray) -> np.ndarray:
        """``_side`` of many words: one row for each word and class beside it, summed up by word."""
        k, out = self.classes, np.zeros((len(own), self.classes))
        w, some = np.nonzero(near)
        add, at = near[w, some], own[w]
        x, was = m[some, :k], f[some, :k]
        e = np.flatnonzero(at < k)
        x[e, at[e]] -= add[e]
        p = np.flatnonzero(some == at)
        x[p] -= back[w[p], :k]
        q = p[at[p] < k]
        x[q, at[q]] -= self_[w[q]]
        was[p] = xlogx(x[p])
        was[e, at[e]] = xlogx(x[e, at[e]])
        x += add[:, None]
        x = x * np.log(x) - was
        if len(w):
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[w[first]] = np.add.reduceat(x, first, axis=0)
        return out


def best_class(own: int, side: np.ndarray, c: np.ndarray, n: np.ndarray, matrix: np.ndarray, classes: int) -> int:
    return Gains(matrix, classes).best(own, side, c, n)


def numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where each row's begin and the last ends) of a column of numbers, or of arrays of them as bytes."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy(), np.arange(len(column) + 1)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, and the sum of its numbers."""
    code, n = map(np.concatenate, zip(*held, strict=True))
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
    return code[first], np.add.reduceat(n[order], first) if len(code) else n


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (sa, sub, sb), and by slice: sums up equal pairs of each and packs them into rows of CHUNK at most. Pairs beyond 4 * SLICE
    that are not summed yet are summed by themselves, as are those that follow; a round adds up what is left apart."""
    at, held, size = None, [], 0

    def packed(code, n):
        for i in range(0, len(code), CHUNK):
            part = slice(i, i + CHUNK)
            yield record(CHUNKS, *([x] for x in at), *([x.astype(t).tobytes()] for x, t in ((code[part] >> 32, "<u2"), (code[part] & 0xFFFFFFFF, "<u4"), (n[part], "<i8"))))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("sa", "sub", "sb")], axis=1)
        (a, ends), (b, _), (n, _) = (numbers(batch.column(c), t) for c, t in (("la", "<u2"), ("lb", "<u4"), ("n", "<i8")))
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key, part = tuple(keys[i].tolist()), slice(ends[i], ends[j])
            if held and key != at:
                yield from packed(*summed(held))
                held, size = [], 0
            at = key
            held.append((a[part].astype(np.int64) << 32 | b[part], n[part]))
            size += len(held[-1][0])
            if size > 4 * SLICE:
                held = [summed(held)]
                size = len(held[0][0])
                if size > 2 * SLICE:
                    yield from packed(*held[0])
                    held, size = [], 0
    if held:
        yield from packed(*summed(held))


def chunked(pairs: DataFrame) -> DataFrame:
    """Chunks of ``dealt`` rows."""
    d = pairs.repartition("sa", "sub", "sb", "slice").sortWithinPartitions("sa", "sub", "sb", "slice")
    return d.mapInArrow(chunk_batches, "sa int, sub int, sb int, a binary, b binary, n binary")


def class_batches(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, place): the classes of each shard's words as one row, with the phase in which they may move."""
    at, held = None, []
    for batch in batches:
        for shard, c, phase in zip(*(batch.column(x).to_pylist() for x in ("shard", "c", "phase")), strict=True):
            if shard != at:
                if held:
                    yield record(CLASSES, [at], [np.array(held, dtype="<u2").tobytes()], [0])
                at, held = shard, []
            held.append(phase << PHASE | c)
    if held:
        yield record(CLASSES, [at], [np.array(held, dtype="<u2").tobytes()], [0])


def first_batches(batches: Iterator[pa.RecordBatch], shards: int, settings: Settings) -> Iterator[pa.RecordBatch]:
    """Pairs of chunks with the classes of both sides as ``dealt`` rows, where all words that move in the second phase only stand as their tail class."""
    held, size, mask, tails = [], 0, (1 << PHASE) - 1, settings.tails
    matrix = np.zeros(tails * tails)
    for batch in batches:
        for r in range(batch.num_rows):
            sa, sub, sb, *blobs = (batch.column(c)[r].as_py() for c in ("sa", "sub", "sb", "a", "b", "n", "of_a", "of_b"))
            a, b, n, of_a, of_b = (np.frombuffer(x, dtype=t) for x, t in zip(blobs, ("<u2", "<u4", "<i8", "<u2", "<u2"), strict=True))
            of_a, of_b = of_a[sub * SUB :][a], of_b[b]
            later_a, later_b = (np.full(len(of), True) if s == shards else of >> PHASE == 2 for s, of in ((sa, of_a), (sb, of_b)))
            tail_a, tail_b = ((of & mask).astype(np.int64) - settings.classes for of in (of_a, of_b))
            both = later_a & later_b
            matrix += np.bincount(tail_a[both] * tails + tail_b[both], n[both], tails * tails)
            code, n = summed([((np.where(later_a, SUB + tail_a, a) << 33 | np.where(later_b, (1 << 32) + tail_b, b))[~both], n[~both])])
            a, b = code >> 33, code & (1 << 33) - 1
            held.append((np.where(a < SUB, (sa << 32) + sub * SUB + a, SUB - 1 - a), np.where(b < 1 << 32, (sb << 32) + b, (1 << 32) - 1 - b), n))
            size += len(n)
            if size >= 2 * SLICE:
                yield from dealt(*map(np.concatenate, zip(*held, strict=True)), shards, 1)
                held, size = [], 0
    code = np.flatnonzero(matrix)
    held.append((-1 - code // tails, -1 - code % tails, matrix[code].astype(np.int64)))
    yield from dealt(*map(np.concatenate, zip(*held, strict=True)), shards, 1)


def movable(of: np.ndarray, places: np.ndarray, phase: int, turn: int) -> np.ndarray:
    """Which words may move: those of the phase and earlier ones, a third in each round. Phase 0 never moves."""
    own = of[places] >> PHASE
    return (own > 0) & (own <= phase) & (places % 3 == turn % 3)


def near_batches(batches: Iterator[pa.RecordBatch], size: int, phase: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Sums over chunks with the classes of both sides: (shard, sub, own, codes, n), a code being word x place of a class beside it; and the
    counts of neighbouring classes, one row a task. Places: classes after the word, classes before it, the word itself."""
    width, mask = 2 * size + 1, (1 << PHASE) - 1
    matrix = np.zeros(size * size)

    def sums(shard: int, of: np.ndarray, code: np.ndarray, n: np.ndarray):
        names, inverse = np.unique(code, return_inverse=True)
        total = np.bincount(inverse, n, len(names)).astype("<i8")
        subs = names // (SUB * width)
        for sub in np.unique(subs).tolist():
            i, j = np.searchsorted(subs, (sub, sub + 1))
            own = of[sub * SUB : (sub + 1) * SUB]
            yield shard, sub, own.tobytes(), (names[i:j] - sub * SUB * width).astype("<u4").tobytes(), total[i:j].tobytes(), None

    for batch in batches:
        for r in range(batch.num_rows):
            sa, sub, sb, *blobs = (batch.column(c)[r].as_py() for c in ("sa", "sub", "sb", "a", "b", "n", "of_a", "of_b"))
            a, b, n, of_a, of_b = (np.frombuffer(x, dtype=t) for x, t in zip(blobs, ("<u2", "<u4", "<i8", "<u2", "<u2"), strict=True))
            a, b = a.astype(np.int64) + sub * SUB, b.astype(np.int64)
            ca, cb = (of_a[a] & mask).astype(np.int64), (of_b[b] & mask).astype(np.int64)
            matrix += np.bincount(ca * size + cb, n, size * size)
            self_ = (a == b) & (sa == sb)
            out = []
            for shard, of, x, code, which in (
                (sa, of_a, a, np.where(self_, 2 * size, cb), movable(of_a, a, phase, turn)),
                (sb, of_b, b, size + ca, movable(of_b, b, phase, turn) & ~self_),
            ):
                if which.any():
                    out += sums(shard, of, x[which] * width + code[which], n[which])
            if out:
                yield record(NEAR, *zip(*out, strict=True))
    yield record(NEAR, [None], [None], [None], [None], [None], [matrix.astype(np.int64)])


def move_batches(batches: Iterator[pa.RecordBatch], matrix: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, sub): the words of each that move, and where to."""
    size = len(matrix)
    width, mask, gains = 2 * size + 1, (1 << PHASE) - 1, Gains(matrix, classes)
    at, own, held = None, None, []

    def moves():
        code, inverse = np.unique(np.concatenate([np.frombuffer(c, dtype="<u4") for c, _ in held]).astype(np.int64), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([np.frombuffer(x, dtype="<i8") for _, x in held]), len(code))
        word, place = np.divmod(code, width)
        side, c = np.where(place < size, 1, np.where(place < 2 * size, 0, 2)), place % size
        ids, to = [], []
        names, nth = np.unique(word, return_inverse=True)
        edges = np.searchsorted(nth, np.arange(0, len(names) + AT_ONCE, AT_ONCE))
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            some = names[k * AT_ONCE : (k + 1) * AT_ONCE]
            was = (own[some] & mask).astype(np.int64)
            best = gains.bests(was, nth[i:j] - k * AT_ONCE, side[i:j], c[i:j], n[i:j])
            moved = np.flatnonzero(best != was)
            ids += (some[moved] + at[1] * SUB).tolist()
            to += best[moved].tolist()
        if ids:
            yield record(MOVES, [at[0]], [np.array(ids, dtype="<i8").tobytes()], [np.array(to, dtype="<u2").tobytes()])

    for batch in batches:
        for r in range(batch.num_rows):
            key = tuple(batch.column(c)[r].as_py() for c in ("shard", "sub"))
            if key != at:
                if held:
                    yield from moves()
                at, own, held = key, np.frombuffer(batch.column("own")[r].as_py(), dtype="<u2"), []
            held.append(tuple(batch.column(c)[r].as_py() for c in ("codes", "n")))
    if held:
        yield from moves()


def apply_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each shard after its moves."""
    mask = (1 << PHASE) - 1
    for batch in batches:
        for shard, of, moves in zip(*(batch.column(c).to_pylist() for c in ("shard", "of", "moves")), strict=True):
            of, n = np.frombuffer(of, dtype="<u2").copy(), 0
            for m in moves or []:
                ids, to = np.frombuffer(m["ids"], dtype="<i8"), np.frombuffer(m["to"], dtype="<u2")
                of[ids] = of[ids] & ~np.uint16(mask) | to
                n += len(ids)
            yield record(CLASSES, [shard], [of.tobytes()], [n])


def likelihood(m: np.ndarray) -> float:
    return float(xlogx(m).sum() - xlogx(m.sum(axis=1)).sum() - xlogx(m.sum(axis=0)).sum())


def settle(chunks: DataFrame, of: DataFrame, shards: int, words: tuple[int, int], settings: Settings) -> tuple[DataFrame, np.ndarray]:
    """(classes of each shard, counts of neighbouring classes) by exchange, first of the ``words[0]`` most frequent words among themselves, then of all.

    A third of the words may move in a round, so neighbours seldom move at once. A phase ends when under ``delta`` of its words moved in three
    rounds or the likelihood did not rise in them. A chunk meets the classes of its two shards by joins: broadcast, two bytes a word,
    as long as the words fill SHARDS shards of SHARD at most, so that no round moves the chunks; sort-merge beyond. The first phase reads sums
    of the chunks by the words that move in it and the tail classes of the others, which stay.
    """
    size = settings.classes + settings.tails
    how = "broadcast" if words[1] <= SHARD * SHARDS else "merge"

    def beside(chunks: DataFrame, of: DataFrame) -> DataFrame:
        side = lambda s, c: of.select(F.col("shard").alias(s), F.col("of").alias(c)).hint(how)
        return chunks.join(side("sa", "of_a"), "sa").join(side("sb", "of_b"), "sb")

    first = stage(chunked(beside(chunks, of).mapInArrow(lambda it: first_batches(it, shards, settings), DEALT_SCHEMA)), "first-chunks")
    for phase in (1, 2):
        turn, changes, values = 0, [], []
        while True:
            d = beside(first if phase == 1 else chunks, of)
            near = d.mapInArrow(lambda it, p=phase, t=turn: near_batches(it, size, p, t), "shard int, sub int, own binary, codes binary, n binary, m array<long>")
            near = stage(near, "near")
            m = np.zeros(size * size)
            for i, x in near.filter("shard is null").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col")).collect():
                m[i] = x
            m = m.reshape(size, size)
            values.append(likelihood(m))
            full = turn >= 3 and turn % 3 == 0
            if words[phase - 1] < 2 or full and (sum(changes[-3:]) <= settings.delta * words[phase - 1] or values[-1] <= values[-4]):
                discard(near)
                break
            dealt = near.filter("shard is not null").select("shard", "sub", "own", "codes", "n").repartition("shard", "sub").sortWithinPartitions("shard", "sub")
            moves = dealt.mapInArrow(lambda it, m=m, k=settings.classes if phase == 1 else size: move_batches(it, m, k), "shard int, ids binary, to binary")
            moves = moves.groupBy("shard").agg(F.collect_list(F.struct("ids", "to")).alias("moves"))
            then = stage(of.join(moves, "shard", "left").select("shard", "of", "moves").mapInArrow(apply_batches, "shard int, of binary, moved long"), "classes")
            discard(near)
            discard(of)
            of = then
            changes.append(of.agg(F.sum("moved")).first()[0] or 0)
            turn += 1
        if phase == 1:
            discard(first)
    return of, m


def most_frequent(lexicon: DataFrame, settings: Settings) -> tuple[Often, int]:
    """The words seen as often as the second value or more, at most ``lookup`` of them, and the end of a text."""
    many, least = 0, 1
    # one row for each count that occurs: no more than the square root of twice the tokens
    for n, words in sorted(lexicon.filter(F.col("word") != F.lit(bytearray(END))).groupBy("n").agg(F.count(F.lit(1))).collect(), reverse=True):
        many += words
        if many > settings.lookup:
            least = n + 1
            break
    t = lexicon.filter((F.col("n") >= least) | (F.col("word") == F.lit(bytearray(END)))).select("word", "n", F.coalesce("id", settings.classes - 1 - F.col("tail")).alias("id")).toArrow()
    hashes, n, number = hashed(t), t.column("n").to_numpy(), t.column("id").to_numpy()
    own, first = np.unique(hashes[hashes > 0], return_index=True)
    at = np.flatnonzero(hashes > 0)[first]
    end = hashes == 0
    return Often(Lookup(own), np.append(number[at], number[end][0] if end.any() else -1), np.append(n[at], n[end].sum())), least


def hashed(words: pa.Table) -> np.ndarray:
    """Hashes of the column ``word``; 0 for the end of a text."""
    names = [bytes(w) for w in words.column("word").to_pylist()]
    out = np.zeros(len(names), dtype=np.uint64)
    some = [i for i, w in enumerate(names) if w != END]
    out[some] = WordHashes().of([names[i] for i in some])[0]
    return out


def classes_of(lexicon: DataFrame, often: Often, least: int) -> np.ndarray:
    t = lexicon.filter((F.col("n") >= least) & (F.col("word") != F.lit(bytearray(END)))).select("word", "c").toArrow()
    out = np.zeros(len(often.n), dtype=np.int64)
    out[often.lookup.find(hashed(t))] = t.column("c").to_numpy()
    return out


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model and (word, n), the counts of all words in ``docs``. No documents at all make a model that knows nothing."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "word-counts")
    end = F.col("word") == F.lit(bytearray(END))
    tokens, distinct, clustered = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if((F.col("n") >= settings.least) | end)).first())
    k, tails = settings.classes, settings.tails
    # words by shard and place in it; none for those that stay in tail classes
    first = (F.col("n") * settings.cluster >= tokens) | end
    taking = first | (F.col("n") >= settings.least)
    shards = max(1, min(SHARDS, -(-clustered // SHARD)))
    lexicon = counts.withColumn("tail", tail_column(settings)).withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int"))
    nth = F.row_number().over(W.partitionBy("shard").orderBy("word")) - 1
    placed = lexicon.filter(taking).withColumn("id", F.shiftleft(F.col("shard").cast("long"), 32) + nth).withColumn("phase", F.when(end, 0).when(first, 1).otherwise(2))
    lexicon = stage(placed.unionByName(lexicon.filter(~taking), allowMissingColumns=True).withColumn("w", symbol_column(settings)), "lexicon")
    often, least = most_frequent(lexicon, settings)
    # without joins if all clustered words are among the most frequent
    joins = least > max(1, min(settings.least, -(-tokens // settings.cluster)))
    slices = min(SUB, 1 + tokens // (SLICE * (1 + clustered // SUB) * (shards + 1)))
    shared = spark.sparkContext.broadcast(often)
    d = docs.select("text").mapInArrow(lambda it: pair_batches(it, shared.value, settings, joins, shards, slices), f"{DEALT_SCHEMA}, a long, b long, k long")
    if joins:
        pairs = stage(d, "pairs")
        # words below the most frequent by sort-merge joins; those seen too seldom become their tail class. Pairs without such words pass by
        numbered = lexicon.filter("id is not null").groupBy("w").agg(F.min("id").alias("id"))
        joined = pairs.filter("k is not null").select("a", "b", "k")
        for x in ("a", "b"):
            joined = joined.join(numbered.hint("merge"), F.col(x) == F.col("w"), "left").withColumn(x, F.when(F.col(x) < SYMBOL, F.col(x)).otherwise(F.coalesce("id", -1 - F.pmod(F.col(x) - SYMBOL, F.lit(tails))))).select("a", "b", "k")
        d = pairs.filter("k is null").select(*DEALT.names).unionByName(joined.mapInArrow(lambda it: deal_batches(it, shards, slices), DEALT_SCHEMA))
    chunks = stage(chunked(d.select(*DEALT.names)), "chunks")
    if joins:
        discard(pairs)
    # the first words begin dealt out over the classes, the others in their tail class; the end of a text has class 0
    begun = F.when(end, 0).when(first, 1 + F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(max(1, k - 1)))).otherwise(F.col("tail"))
    of = lexicon.filter("id is not null").select("shard", "id", begun.cast("int").alias("c"), "phase").repartition("shard").sortWithinPartitions("id")
    of = of.mapInArrow(lambda it: class_batches(it, settings), "shard int, of binary, moved long")
    fixed = spark.createDataFrame([(shards, bytearray((k + np.arange(tails)).astype("<u2").tobytes()), 0)], "shard int, of binary, moved long")
    n_first = lexicon.filter("phase = 1").count()
    of, m = settle(chunks, stage(of.unionByName(fixed), "classes"), shards, (n_first, clustered), settings)
    discard(chunks)
    at = of.filter(F.col("shard") < shards).mapInArrow(named_batches, "id long, c int")
    lexicon = lexicon.join(at.hint("merge"), "id", "left").select("word", "n", F.coalesce("c", "tail").alias("c"))
    lexicon = stage(lexicon, "word-classes")
    often.c = classes_of(lexicon, often, least)
    model = Model(settings, tokens, distinct, often, least, lexicon=lexicon)
    into = m.sum(axis=0)
    own = (into + 1) / (into.sum() + len(into))
    model.step = np.log10((m + settings.pull * own[None]) / (m.sum(axis=1, keepdims=True) + settings.pull))
    kinds = np.zeros(len(into))
    total = np.zeros(len(into))
    for c, kind, n in lexicon.groupBy("c").agg(F.count(F.lit(1)), F.sum("n")).collect():
        kinds[c], total[c] = kind, n
    model.mass = np.log10(total + kinds + 1)
    return model, counts


def named_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class) of all words of each shard."""
    for batch in batches:
        for shard, of in zip(batch.column("shard").to_pylist(), batch.column("of").to_pylist(), strict=True):
            c = np.frombuffer(of, dtype="<u2") & ((1 << PHASE) - 1)
            yield record(NAMED, (shard << 32) + np.arange(len(c)), c.astype(np.int32))


def score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """All of a text's score but what words that are looked up by a join add; each is listed with its place and the classes beside it, -1 for such a word."""
    row = TaskContext.get().partitionId() << 40
    unit = math.log10(model.tokens + model.distinct + 1)
    step, mass, often = model.step, model.mass, model.often
    log, c_of = np.append(np.log10(often.n + 1.0), 0.0), np.append(often.c, -1)  # the last for a word that is not there
    known = np.append(often.n > 0, False)
    for batch in batches:
        ids, held_out_ = batch.column("doc_id"), batch.column("held_out")
        for first, held, places, ends in often.places(batch):
            c = c_of[places]
            before = np.concatenate([c_of[[often.end]], c[:-1]])
            counted = log[places]
            both = (c >= 0) & (before >= 0)
            more = counted - np.where(c >= 0, mass[c], 0.0) + np.where(both, step[before, c], 0.0)
            begins = np.concatenate([[0], ends[:-1] + 1])
            n = ends - begins + 1
            total, unigram = np.add.reduceat(more, begins), np.add.reduceat(counted, begins)
            where, words, of, at = not_found(held, places, ends)
            listed = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(at, pa.int32()), pa.array(before[where], pa.int32()), pa.array(c[where + 1], pa.int32())], fields=list(RARE))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(held) + 1)), pa.int32()), listed)
            rows = row + np.arange(len(held))
            n_known = np.add.reduceat(known[places].astype(np.int64), begins)
            part = slice(first, first + len(held))
            yield record(SCORED, rows, ids[part], held_out_[part], n, n_known, unigram - n * unit, total, lists.cast(SCORED.field("rare").type))
            row += len(held)


def rare_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """What the listed words of each row (row, rare: at, left, right, c, n) add to its score."""
    step, mass = model.step, model.mass
    for batch in batches:
        if batch.num_rows:
            rare = batch.column("rare")
            at, left, right, c, n = (rare.flatten().field(k).to_numpy() for k in range(5))
            of = np.repeat(np.arange(batch.num_rows), rare.value_lengths().to_numpy())
            order = np.lexsort((at, of))
            left, right, c, n, of = left[order], right[order], c[order], n[order], of[order]
            # a word without a class beside it follows the word listed before
            before = np.where(left < 0, np.roll(c, 1), left)
            more = step[before, c] + np.where(right < 0, 0.0, step[c, np.maximum(right, 0)]) - mass[c]
            total = lambda x: np.bincount(of, x, batch.num_rows)
            yield record(FOUND, batch.column("row"), total(n > 0).astype(np.int64), total(np.log10(n + 1.0)), total(more))


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """crc32 of the id's decimal text; a null id is in the training part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): every row, scored by a model of those not held out.

    Tokens are words between white space, A-Z lower-cased, and one end per text; a null or empty text is its end alone. ``base_score`` is
    the add-one unigram score, ``score`` the model's log10 probability; a word never seen has one share of its class.
    Repeated rows count as often as they occur and are scored each. An empty table gives no rows; without training
    rows all words are unknown.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    model, counts = train(d.filter(~F.col("held_out")), settings)
    shared = d.sparkSession.sparkContext.broadcast(model)
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,at:int,left:int,right:int>>"
    part = stage(d.mapInArrow(lambda it: score_batches(it, shared.value), schema), "scored")
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    below = model.lexicon.filter(F.col("n") < model.least)
    # sort-merge: neither side has a size bound
    rare = rare.join(below.hint("merge"), "word", "left").select(
        "row", F.struct("at", "left", "right", F.coalesce("c", tail_column(settings)).alias("c"), F.coalesce("n", F.lit(0)).alias("n")).alias("r")
    )
    rare = rare.groupBy("row").agg(F.collect_list("r").alias("rare"))
    seen = rare.mapInArrow(lambda it: rare_batches(it, shared.value), "row long, known long, counted double, more double")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("rare").join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("counted")).alias("base_score"), (F.col("score") + more("counted") + more("more")).alias("score"),
    )
