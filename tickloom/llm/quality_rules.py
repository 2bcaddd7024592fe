"""Quality rules as a ledger: each rule is judged once per document and leaves one bit and its measurements.

Policies are versioned bit masks over the ledger, so a new policy or an ablation costs no second look at the texts.
Everything is a column expression on one row: no shuffle, no Python on the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, let, words

SYMBOLS = "[#*$%&|<>]"  # fixed value

MEASURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_digits": "long",
}

#: Rule -> failed, over the measurements. The place in this dictionary is the rule's bit; append, never reorder.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_phrases": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 4 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "digit_heavy": "2 * n_digits > word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document stays when it fails none of the rules named."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_phrases"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "symbol_heavy", "repeated_lines")), Policy("v2", tuple(RULES)))}
CURRENT = POLICIES["v2"]


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, of an array of words.

    Windows are compared by a 64-bit hash. A sort of longs that hold the hash's low bits above the position brings
    equal windows together; neighbours with equal low bits are the few positions worth an exact sort.
    """

    def covered(starts: Column) -> Column:
        step = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

    def beside(pairs: Column, same) -> Column:
        """Elements of a sorted array that match a neighbour."""
        after = F.slice(pairs, 2, F.size(pairs))
        hit = F.zip_with(pairs, after, lambda a, b: F.coalesce(same(a, b), F.lit(False)))
        return let(hit, lambda h: F.filter(pairs, lambda x, i: h[i] | F.when(i > 0, h[F.greatest(i - 1, F.lit(0))]).otherwise(False)))

    def exact(hashes: Column, near: Column) -> Column:
        pairs = F.array_sort(F.transform(near, lambda p: F.struct(hashes[p].alias("h"), p.alias("p"))))
        hits = let(pairs, lambda q: beside(q, lambda a, b: a["h"] == b["h"]))
        return let(F.sort_array(F.transform(hits, lambda x: x["p"])), covered)

    def of(hashes: Column) -> Column:
        # bits that a position needs; a power of two of the size, computed without a loop
        bits = F.ceil(F.log2(F.size(hashes) + F.lit(1))).cast("int") + 1
        packed = let(bits, lambda b: F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, b).bitwiseOR(i.cast("long"))))
        low = let(bits, lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)
        sort = F.sort_array(packed)
        near = let(low, lambda m: let(sort, lambda s: F.transform(
            beside(s, lambda a, b: a.bitwiseXOR(b).between(F.lit(0), m)),
            lambda x: x.bitwiseAND(m).cast("int"),
        )))
        return let(near, lambda n: F.when(F.size(n) == 0, F.lit(0).cast("long")).otherwise(exact(hashes, n)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, of))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``measures_``; a null or empty text measures 0 everywhere but n_lines (1 empty line)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    with_word = F.filter(lines, lambda x: F.regexp_replace(x, SPACE, "") != "")
    bare = F.regexp_replace(text, SPACE, "")
    chars = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    of_words = let(words(F.col("text")), lambda x: F.struct(F.size(x).alias("n"), repeat_words(x).alias("repeat")))
    dup_lines = let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    pair = F.struct(of_words.alias("w"), F.char_length(bare).alias("word_chars"), chars(SYMBOLS).alias("n_symbols"), dup_lines.alias("n_dup_lines"),
                    F.size(lines).alias("n_lines"), chars("[0-9]").alias("n_digits"))
    own = {"n_words": "w.n", "n_repeat_words": "w.repeat"}
    values = [F.col(f"measures_.{own.get(m, m)}").cast(t).alias(m) for m, t in MEASURES.items()]
    return docs.withColumn("measures_", pair).withColumn("measures_", F.struct(*values))


def failed_bits(prefix: str = "") -> Column:
    """One bit for each rule that the measures fail."""
    failed = F.lit(0).cast("long")
    for name, rule in RULES.items():
        for m in MEASURES:
            rule = re.sub(rf"\b{m}\b", f"{prefix}{m}", rule)
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0).cast("long"))
    return failed


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, *MEASURES, failed): ``failed`` has the bit of every rule that the document fails.

    Rows are judged one by one, so repeated rows and ids get equal results and null ids stay; an empty table gives no
    rows. Measures count the whole text, however long.
    """
    return measured(docs.select("doc_id", "text")).select("doc_id", "measures_.*").withColumn("failed", failed_bits())


def filter_documents(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass the policy, unchanged."""
    judged = measured(docs)
    return judged.filter(failed_bits("measures_.").bitwiseAND(policy.mask) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def passes(policy: Policy = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(policy.mask) == 0


def verdicts(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    return book.select("*", F.lit(policy.version).alias("policy"), passes(policy).alias("kept"))


def ablation(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(rule, rejected, only_by_rule, kept_without): what each rule of the policy does, from counts of bit patterns.

    The ledger is first counted by its failure bits, at most 2 to the number of rules rows, whatever its size.
    """
    patterns = book.groupBy(F.col("failed").bitwiseAND(policy.mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    d = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return d.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("rejected"),
        count(F.col("bits") == F.col("bit"))("only_by_rule"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without"),
    )
