"""Token counts by greedy longest match, in one look at each byte and without building tokens.

The vocabulary is a trie with failure links: where no token goes on, the link leads to the place in the trie that the
rest of the bytes has reached, and the node says how many tokens are finished on the way. A count is a sum over links.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import record, texts

COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])
END = 256  # the symbol that ends every word
MAX_WORDS = 500_000  # distinct words remembered by a task; beyond, the memory starts anew
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def word_end_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Tokens of a BPE vocabulary file with word ends, as bytes with END for the mark </w>.

    Its characters stand for bytes: printable Latin-1 ones for themselves, the others from 256 on in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = []
    for token in vocabulary:
        body = token.removesuffix("</w>")
        if body and all(c in byte for c in body):
            out.append((*[byte[c] for c in body], *[END] * token.endswith("</w>")))
    return out


class LongestMatch:
    """Automaton over symbols. ``step[v][c]`` is a child, ``link[v]`` the failure link (-1: none), ``popped[v]`` the tokens finished by it."""

    def __init__(self, tokens: Iterable[tuple[int, ...]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        whole = [False]
        for token in tokens:
            v = 0
            for c in token:
                if c not in self.step[v]:
                    self.step[v][c] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                v = self.step[v][c]
            whole[v] = True
        # a mark that is left over after the last token is no token of its own
        end = self.step[0].setdefault(END, len(self.step))
        if end == len(self.step):
            self.step.append({})
            whole.append(True)
        self.link, self.popped = [-1] * len(self.step), [0] * len(self.step)
        row = [0]
        while row:  # breadth first: links lead to shorter strings
            below = []
            for u in row:
                for c, v in self.step[u].items():
                    below.append(v)
                    if whole[v]:
                        self.link[v], self.popped[v] = 0, int(v != end)
                        continue
                    z, n = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.step[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.step[z][c], n
            row = below

    def count(self, word: bytes) -> int:
        """Tokens of the word and its end, longest first from the left; 0 if some part is in no token.

        A longest match may leave the end mark alone; it costs nothing then.
        """
        v = n = 0
        step, link, popped = self.step, self.link, self.popped
        for c in (*word, END):
            while c not in step[v]:
                if link[v] < 0:
                    return 0
                n += popped[v]
                v = link[v]
            v = step[v][c]
        while v:
            if link[v] < 0:
                return 0
            n += popped[v]
            v = link[v]
        return n


@lru_cache(maxsize=2)
def load(path: str) -> LongestMatch:
    return LongestMatch(word_end_vocabulary(path))


def count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    automaton = load(path)
    known: dict[bytes, int] = {}
    for batch in batches:
        n_words, n_tokens, n_unknown = [], [], []
        for text in texts(batch):
            own = text.translate(LOWER).split()  # bytes.split() parts at the six ASCII white space characters
            known.update((w, automaton.count(w)) for w in set(own) if w not in known)
            counts = [known[w] for w in own]
            unknown = counts.count(0)
            n_words.append(len(own))
            n_tokens.append(sum(counts) + unknown)
            n_unknown.append(unknown)
            if len(known) > MAX_WORDS:
                known.clear()
        yield record(COUNTED, batch.column("doc_id"), n_words, n_tokens, n_unknown)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of the whole text, A-Z lower-cased, by the vocabulary in ``path``.

    Words lie between white space; a word that the vocabulary cannot cover counts as one token and is counted in ``n_unknown``.
    A null or empty text has 0 of each. Rows are independent: repeated rows, null ids and an empty table come out
    as they go in; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda it: count_batches(it, path), "doc_id long, n_words long, n_tokens long, n_unknown long")
