"""A corpus pipeline: each stage takes the documents that the one before kept and returns what it keeps.

quality_rules   documents that fail the current policy go
line_dedup      lines of 40 characters or more in 5 documents or more stay in the largest doc_id only
near_duplicates of each group of linked documents (five-word shingles, similarity 0.8) the smallest doc_id stays
mixture         each source's documents are repeated or thinned to its target; a document taken k times is k rows
byte_bpe        the token ids of what is left, and the decoded text

Null ids and texts, empty tables and further columns pass through as the operators define. In the last three stages a document is
told by a 64-bit hash of its doc_id and text, so rows that share an id, or have none, are judged each; rows that are equal in both are copies
of one document, of which one row stays. Of linked documents with one doc_id the one of the smallest hash stays, of null ids only if there is no other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import byte_bpe, jaccard_join, line_dedup, mixing, quality_rules
from tickloom.session import stage

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ledger is made of the rows themselves, so the verdict stands beside the document: no join."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that larger doc_ids hold; ``n_chars`` follows the text."""
    bitmaps = line_dedup.line_keep_bitmaps(docs, min_docs=5, min_chars=40)
    return line_dedup.filter_lines(docs, bitmaps).withColumn("n_chars", F.char_length("text").cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``row_key_``, a hash of id and text."""
    return docs.withColumn("row_key_", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = jaccard_join.similar_components(rows.select(F.col("row_key_").alias("doc_id"), "text"), jaccard_join.Rule(words=5, percent=80))
    found = stage(found.select(F.col("doc_id").alias("row_key_"), F.col("component_id").alias("component")).distinct(), "components")
    ids = stage(rows.select("row_key_", "doc_id"), "row-keys")
    order = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("row_key_").alias("key"))
    stays = ids.join(found, "row_key_").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.key").alias("row_key_"))
    # what goes is bounded by nothing, so sort-merge joins
    go = found.select("row_key_").join(stays.hint("merge"), "row_key_", "left_anti")
    # equal rows are one before anything is dealt, and the join finds them dealt by its key: documents move once
    return rows.dropDuplicates(["row_key_"]).join(go.hint("merge"), "row_key_", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    took = mixing.mix(rows.select(F.col("row_key_").alias("doc_id"), "text", "source"), weights=(5, 2, 1), max_repeat=3).filter("copies > 0")
    took = took.groupBy("doc_id").agg(F.max("copies").alias("copies")).select(F.col("doc_id").alias("row_key_"), F.col("copies").alias("row_copies_"))
    d = rows.join(took.hint("merge"), "row_key_")
    return d.select(*docs.columns, F.explode(F.sequence(F.lit(1), "row_copies_")).alias("copy_")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, text): ids and the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    return done.select("doc_id", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("byte_bpe", tokens)]

#: Similarity, the knapsack and the merges can't be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
