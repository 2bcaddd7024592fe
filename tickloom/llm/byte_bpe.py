"""Byte-level BPE: merges replayed over the distinct pieces of a task's documents.

The pieces of many documents form one corpus of distinct byte strings. An inverted index from token pair to positions
says where a merge applies; merges are taken in rank order, each updates its neighbours' pairs only. Documents
are then the concatenation of their pieces' ids. Encoding needs no shuffle: each task replays its own corpus, in portions of bounded size.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import int_lists, record

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([*ENCODED, ("decoded", pa.binary())])
PORTION = 12_000_000  # characters of text whose pieces are one corpus; a longer text is a corpus of its own
LONG = 64  # bytes; longer pieces are replayed one by one
ROWS = 512  # documents handed on at a time


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern, which may use \\p{L}, \\p{N}, \\s and \\S.

    The classes are spelled out as sets of the first plane, which the re module looks up in a table, several times
    faster than regex; a text beyond that plane goes through regex.
    """
    plane = "".join(c for c in map(chr, range(0x10000)) if not "\ud800" <= c <= "\udfff")
    # fixed value: the white space of Unicode
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def ranges(kind: str) -> str:
        found = [m.span() for m in regex.finditer(rf"\p{{{kind}}}+", plane)]
        return "".join(f"\\u{ord(plane[a]):04x}-\\u{ord(plane[b - 1]):04x}" for a, b in _unbroken(plane, found))

    far = re.compile("[\U00010000-\U0010ffff]").search
    slow = re.sub(r"(\[\^?)?\\([sS])", lambda m: (m[1] or "") + (space if m[1] else f"[{'^' * (m[2] == 'S')}{space}]"), pattern)
    fast = slow
    for kind in "LN":
        own = ranges(kind)
        fast = re.sub(rf"(\[[^\]]*)\\p\{{{kind}\}}", lambda m, own=own: m[1] + own, fast).replace(rf"\p{{{kind}}}", f"[{own}]")
    quick, sure = re.compile(fast).findall, regex.compile(slow).findall
    return lambda text: sure(text) if far(text) else quick(text)


def _unbroken(plane: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of ``plane`` cut where its characters leave out code points."""
    for a, b in spans:
        while a < b:
            e = a + 1
            while e < b and ord(plane[e]) == ord(plane[e - 1]) + 1:
                e += 1
            yield a, e
            a = e


class Ranks:
    """A vocabulary of byte strings by rank; the rank is the id, and the order in which merges apply."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: b for b, i in self.rank.items()}
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        get = self.rank.get
        pairs = sorted(
            (a << 20 | b, r) for t, r in self.rank.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None
        )
        self.pair = np.array([k for k, _ in pairs], dtype=np.int64)
        self.pair_rank = np.array([r for _, r in pairs], dtype=np.int32)

    def merge(self, a: int, b: int) -> int:
        """Id of the two tokens' concatenation, or -1."""
        if (r := self.merged.get((a, b))) is None:
            r = self.merged[a, b] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``merge`` of many pairs; -1 where one of them is no token."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], -1)

    def encode_all(self, corpus: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and where each piece's ids begin, as if each piece were encoded alone."""
        blocks: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(corpus)
        short = []
        for n, piece in enumerate(corpus):
            if (whole := self.rank.get(piece)) is not None:
                blocks[n] = np.array([whole], dtype=np.int32)
            elif len(piece) > LONG:
                ids = [*map(self.byte.__getitem__, piece), -1]
                self._replay(ids)
                blocks[n] = np.array([i for i in ids if i >= 0], dtype=np.int32)
            else:
                short.append(n)
        for n, ids in zip(short, self._replay_many([corpus[n] for n in short]), strict=True):
            blocks[n] = ids
        starts = np.zeros(len(corpus) + 1, dtype=np.int64)
        np.cumsum([len(b) for b in blocks], out=starts[1:])
        return np.concatenate([*blocks, np.zeros(0, dtype=np.int32)]), starts

    def _replay_many(self, corpus: list[bytes]) -> list[np.ndarray]:
        """The replay for many short pieces at once: each step applies one rank at all its positions."""
        if not corpus:
            return []
        ends = np.cumsum([len(p) + 1 for p in corpus])
        raw = np.frombuffer(b"\0".join(corpus) + b"\0", dtype=np.uint8)
        ids = np.array(self.byte, dtype=np.int32)[raw]
        ids[ends - 1] = -1  # no pair crosses the end of a piece
        n = len(ids)
        piece = np.repeat(np.arange(len(corpus)), np.diff(ends, prepend=0))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        where: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def note(spots: np.ndarray, ranks: np.ndarray) -> None:
            some = ranks >= 0
            spots, ranks = spots[some], ranks[some]
            if not len(spots):
                return
            order = np.argsort(ranks, kind="stable")
            spots, ranks = spots[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(spots, cuts) if len(cuts) else [spots], strict=True):
                if r in where:
                    where[r].append(own)
                else:
                    where[r] = [own]
                    heappush(due, r)

        note(np.arange(n - 1), self.merges(ids[:-1], ids[1:]))
        while due:
            r = heappop(due)
            spots = where.pop(r)
            spots = np.concatenate(spots) if len(spots) > 1 else spots[0]
            # a spot may have been swallowed or changed since it was noted
            spots = spots[self.merges(ids[spots], ids[after[spots]]) == r]
            if not len(spots):
                continue
            spots = np.unique(spots)
            own = piece[spots]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            if not first.all():  # equal ranks merge from the left, and what that makes possible may come sooner
                where[r] = [spots[~first]]
                heappush(due, r)
                spots = spots[first]
            j = after[spots]
            k = after[j]
            ids[spots], ids[j] = r, -2
            after[spots], before[k] = k, spots
            left = before[spots]
            new = np.full(len(spots), r, dtype=np.int32)
            note(np.concatenate((left, spots)), self.merges(np.concatenate((ids[left], new)), np.concatenate((new, ids[k]))))
        live = ids >= 0
        return np.split(ids[live], np.cumsum(np.bincount(piece[live], minlength=len(corpus)))[:-1])

    def _replay(self, ids: list[int]) -> None:
        """Merge in place: a token's first position holds its id, positions swallowed by a merge hold -2."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        merge, known = self.merge, self.merged.get
        for i in range(n - 1):
            a, b = ids[i], ids[i + 1]
            if a >= 0 and b >= 0:
                if (r := known((a, b))) is None:
                    r = merge(a, b)
                if r >= 0:
                    where.setdefault(r, []).append(i)
        due = list(where)
        heapify(due)
        while due:
            r = heappop(due)
            spots = where.pop(r, None)
            if spots is None:
                continue
            spots.sort()  # equal ranks merge from the left
            for k, i in enumerate(spots):
                j = after[i]
                # the spot may have been swallowed or changed since it was noted
                if ids[i] < 0 or j >= n or ids[j] < 0 or merge(ids[i], ids[j]) != r:
                    continue
                ids[i], ids[j] = r, -2
                after[i] = nxt = after[j]
                before[nxt if nxt < n else j] = i
                sooner = False
                for left, right in ((before[i], i), (i, nxt)):
                    if left >= 0 and right < n and ids[left] >= 0 and ids[right] >= 0 and (new := merge(ids[left], ids[right])) >= 0:
                        if new in where:
                            where[new].append(left)
                        else:
                            where[new] = [left]
                            heappush(due, new)
                        sooner |= new <= r
                if sooner:  # an earlier merge has become possible: it goes first, the rest of this rank later
                    rest = spots[k + 1 :]
                    if r in where:
                        where[r] += rest
                    elif rest:
                        where[r] = rest
                        heappush(due, r)
                    break


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about PORTION characters each."""
    docs, text, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            docs.append(d)
            text.append(t or "")
            size += len(text[-1])
            if size >= PORTION:
                yield docs, text
                docs, text, size = [], [], 0
    if docs:
        yield docs, text


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    ranks, split = load(path), splitter(pattern)
    for docs, text in portions(batches):
        number: dict[str, int] = {}
        rows = []
        for t in text:
            own = split(t)
            for p in set(own).difference(number):
                number[p] = len(number)
            rows.append(np.fromiter(map(number.__getitem__, own), dtype=np.int32, count=len(own)))
        ids, starts = ranks.encode_all([p.encode() for p in number])
        lengths = np.diff(starts)
        for i in range(0, len(rows), ROWS):
            own = rows[i : i + ROWS]
            flat = np.concatenate(own)
            size = lengths[flat]
            # place of every id: the start of its piece plus its place in it
            ends = np.cumsum(size)
            at = np.repeat(starts[flat] - (ends - size), size) + np.arange(size.sum())
            cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, own)])]
            yield record(ENCODED, docs[i : i + ROWS], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids[at], pa.int32())))


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    token = load(path).token
    for batch in batches:
        decoded = [b"".join(map(token.__getitem__, ids)) for ids in int_lists(batch.column("ids"))]
        yield record(DECODED, batch.column("doc_id"), batch.column("ids"), decoded)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): each match of ``pattern`` in the text encoded by the ranks in ``path``.

    A null or empty text has no ids. Rows are independent: repeated rows, null ids and an empty table come out as they
    go in; other columns are not read. ``path`` is a file that every executor has.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: encode_batches(it, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ``decoded`` is the bytes of the ids, empty for none or null."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: decode_batches(it, path), "doc_id long, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str, then=None, schema: str = "doc_id long, ids array<int>, decoded binary") -> DataFrame:
    """``decode(encode(docs))`` in one pass through Python; ``then`` may map the batches on."""

    def run(it):
        out = decode_batches(encode_batches(it, path, pattern), path)
        return then(out) if then else out

    return docs.select("doc_id", "text").mapInArrow(run, schema)
