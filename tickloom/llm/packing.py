"""Token ids packed into rows of one length, best fit decreasing.

A task packs the documents it reads in windows of bounded size: pieces are placed longest first, each into the open row
whose free space is least but enough; a segment tree over free space finds it. Documents longer than a row are cut, nothing is
dropped, and every piece says which tokens of which document it holds. No shuffle; a lost task packs the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import load

SEGMENT = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int32())])
PACKED = pa.schema([
    ("shard", pa.int32()), ("pack", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
    ("segments", pa.list_(SEGMENT)), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
])
SCHEMA = (
    "shard int, pack long, n_tokens int, ids binary, segments array<struct<doc_id:long,row:long,start:long,length:int>>,"
    " cu_seqlens array<int>, position_resets array<int>"
)


class FreeSpace:
    """Open rows by free space: a tree of counts over 0..capacity, each leaf with the rows that have just that much."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def _add(self, free: int, n: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free space, row) of the fullest row with ``need`` free, removed; None if there is none."""
        i, count = need + self.size, self.count
        if not count[i]:
            # up to the first ancestor with a filled right neighbour, then down its left edge
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; every length is at most ``capacity``. Equal lengths go in order."""
    rows: list[list[int]] = []
    space = FreeSpace(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free, row = space.take(lengths[i]) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if free > lengths[i]:
            space.put(free - lengths[i], row)
    return rows


def pack_window(docs: list[tuple[int | None, int, np.ndarray]], capacity: int, pad: int) -> Iterator[tuple]:
    """(n_tokens, ids, segments, cu_seqlens) of each row for (doc_id, row number, ids) documents."""
    cut = [(d, row, s, ids[s : s + capacity]) for d, row, ids in docs for s in range(0, len(ids), capacity)]
    for row in best_fit_decreasing([len(c[3]) for c in cut], capacity):
        own = [cut[i] for i in row]
        ends = np.cumsum([0, *(len(c[3]) for c in own)])
        ids = np.full(capacity, pad, dtype="<u2")
        ids[: ends[-1]] = np.concatenate([c[3] for c in own])
        yield int(ends[-1]), ids.tobytes(), [{"doc_id": d, "row": r, "start": s, "length": len(x)} for d, r, s, x in own], ends.tolist()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load(path).rank, special_tokens={})


def byte_pair_ids(path: str, pattern: str, end: int) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a vocabulary file, each text closed by the id ``end``."""

    def ids(texts: list[str]) -> list[np.ndarray]:
        encode = tokenizer(path, pattern).encode_ordinary
        return [np.array([*encode(t), end], dtype="<u2") for t in texts]

    return ids


def pack(docs: DataFrame, token_ids: Callable[[list[str]], list[np.ndarray]], *, capacity: int = 4096, pad: int = 0, window: int = 1 << 23) -> DataFrame:
    """(shard, pack, n_tokens, ids, segments, cu_seqlens, position_resets): packed rows of ``capacity`` 16-bit ids.

    ``ids`` is a row of the id matrix, little-endian, filled up with ``pad`` after ``n_tokens``. ``segments`` lists the pieces in it:
    document, number of the document's row in its shard, first token and length. ``cu_seqlens`` are the ends of the pieces summed
    up from 0, ``position_resets`` where position numbers begin anew. Put in order of ``start``, a document's pieces are its ids.
    A window closes at ``window`` tokens, the bound on what a task holds (plus one document). Null texts are empty and
    hold what ``token_ids`` gives for an empty text; repeated rows are packed each; null ids stay null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = n_rows = n_packs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n_packs
            rows = list(pack_window(held, capacity, pad))
            for i in range(0, len(rows), 256):
                n, ids, segments, ends = zip(*rows[i : i + 256], strict=True)
                numbers = range(n_packs, n_packs + len(n))
                n_packs += len(n)
                columns = ([shard] * len(n), list(numbers), n, ids, segments, ends, [e[:-1] for e in ends])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED, strict=True)], schema=PACKED)
            held.clear()

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for d, tokens in zip(ids, token_ids([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                held.append((d, n_rows, tokens))
                n_rows, size = n_rows + 1, size + len(tokens)
                if size >= window:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
