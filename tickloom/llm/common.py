"""What the operators share: word rules, let-binding of columns, hashes, Arrow batch functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: the white space that separates words, as characters and as a pattern
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z only; F.lower would change other letters, too."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Maximal runs of characters outside SPACE_CHARS; a null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE, -1), lambda w: w != "")


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """128 bits in two longs: two xxhash64 values with unrelated seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def text_tag(c: Column) -> Column:
    """Tells rows apart that share a doc_id and differ in text."""
    return F.hash(F.coalesce(c, F.lit("")))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def int_lists(column: pa.ListArray) -> list[list[int]]:
    """The rows of a list column; a null row is empty. Much faster than to_pylist() on lists."""
    values = column.flatten().to_numpy().tolist()
    ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()]).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def record(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


class WordHashes:
    """64-bit hashes of the words of many texts, without a Python object for each word.

    A word of bytes b0 b1 ... is the sum of value(bj) * BASE**j, then mixed. Sums from the start of a block to each byte give all its
    words at once; a power of the inverse of BASE takes a word back to position 0.
    """

    BASE, BLOCK = 0x9E3779B97F4A7C15, 1 << 17

    def __init__(self) -> None:
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.space = np.zeros(256, dtype=bool)
        self.space[list(SPACE_CHARS.encode())] = True
        self._powers(self.BLOCK)

    def _powers(self, n: int) -> None:
        """Powers of BASE and of its inverse, modulo 2**64, for blocks of ``n`` bytes."""
        base = [np.full(n + 1, x, dtype=np.uint64) for x in (self.BASE, pow(self.BASE, -1, 1 << 64))]
        for b in base:
            b[0] = 1
        self.up, self.down = map(np.cumprod, base)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in a row, where each text's words begin and the last ends)."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        space = self.space[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, stops = edges[::2], edges[1::2]
        out = np.empty(len(starts), dtype=np.uint64)
        i = 0
        while i < len(starts):
            at = starts[i]
            j = max(i + 1, int(np.searchsorted(stops, at + self.BLOCK, side="right")))
            size = int(stops[j - 1] - at)
            if size >= len(self.up):
                self._powers(size)
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(self.value[data[at : at + size]] * self.up[:size], out=sums[1:])
            s = starts[i:j] - at
            out[i:j] = (sums[stops[i:j] - at] - sums[s]) * self.down[s]
            i = j
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return mix64(out), np.searchsorted(starts, begins)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours, in order of their starts."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)
