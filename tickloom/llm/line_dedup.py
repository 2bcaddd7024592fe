"""Lines that many documents share: kept in one document, marked for removal elsewhere.

Line hashes are dealt by range, each range sorted by hash, document and position; a stream over the sorted rows
sees the document that keeps a line first and every later occurrence after it. What leaves the stream is one
bitmap per document, not text. A hash bucket with more rows than a task should have is cut into slices by document;
its keys get a second, pre-aggregated step over the slices. No Python runs on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.session import stage

from .common import SPACE_CHARS, ascii_lower, hash_pair, let, shuffle_tasks, text_tag

BUCKET_BITS = 16


def split_lines(text: Column) -> Column:
    """Lines between \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, tag, pos) of every line whose key has ``min_chars`` code points or more."""
    h1, h2 = hash_pair(F.col("key"))
    lines = docs.select("doc_id", text_tag(F.col("text")).alias("tag"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.filter(F.octet_length("line") >= min_chars).select("doc_id", "tag", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"), "doc_id", "tag", "pos")


def line_keep_bitmaps(docs: DataFrame, *, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """(doc_id, tag, keep) for each document that loses a line.

    ``keep`` is a compressed bitmap: 64-line word number -> bits, 1 for a line that stays; words without a removal
    and documents without one are left out. A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents stays in the largest doc_id only (with all its repeats there). Rows with the same doc_id count as one
    document; ``tag`` tells their texts apart. A null doc_id is one document, smaller than all others. Null and empty
    texts are one empty line. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    n = shuffle_tasks(spark)
    occ = stage(occurrences(docs, min_chars), "lines").withColumn("bucket", F.shiftrightunsigned("h1", 64 - BUCKET_BITS))
    sizes = occ.groupBy("bucket").count()
    # a bucket with over a quarter of a task's fair share: at most 4 n of them, so they may be broadcast
    total = occ.count()
    crowded = sizes.filter(F.col("count") > max(64, total / (4 * n))).select("bucket", F.lit(True).alias("crowded"))
    part = F.when(F.col("crowded"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")).otherwise(-1)
    ranged = (
        occ.join(F.broadcast(crowded), "bucket", "left")
        .select("h1", "h2", part.alias("part"), "doc_id", "tag", "pos")
        .repartitionByRange(n, "h1", "h2", "part")
        .sortWithinPartitions("h1", "h2", "part", F.desc("doc_id"), "pos")
    )
    stream = W.partitionBy("h1", "h2", "part").orderBy(F.desc("doc_id"))
    whole = stream.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = (
        ranged.withColumn("nth", F.dense_rank().over(stream))
        .withColumn("n_docs", F.max("nth").over(whole))
        .withColumn("keeper", F.first("doc_id").over(whole))
        .withColumn("first", F.row_number().over(stream) == 1)
    )
    shared = (F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    found = stage(seen.filter((F.col("part") >= 0) | shared).drop("nth"), "shared-lines")
    sliced = found.filter("part >= 0")
    totals = (
        sliced.filter("first").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
    )
    removed = found.filter("part < 0").select("doc_id", "tag", "pos").unionByName(
        sliced.drop("n_docs", "keeper").join(totals, ["h1", "h2"]).filter(shared).select("doc_id", "tag", "pos")
    )
    bits = removed.groupBy("doc_id", "tag", F.shiftright("pos", 6).alias("word")).agg(F.bitwise_not(F.bit_or(line_bit(F.col("pos")))).alias("bits"))
    return bits.groupBy("doc_id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def line_bit(pos: Column) -> Column:
    """The bit of a line in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(63))


def kept_lines(lines: Column, keep: Column) -> Column:
    """Lines whose bit is set; a null bitmap keeps all."""

    def pick(bits: Column) -> Column:
        return F.filter(lines, lambda x, i: F.call_function("shiftright", bits[F.shiftright(i, 6)], i.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1)

    full = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(lines) - 1, 6)), lambda w: F.coalesce(F.element_at(keep, w), F.lit(-1).cast("long")))
    return F.when(keep.isNull(), lines).otherwise(let(full, pick))


def _with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    b = bitmaps.select(F.col("doc_id").alias("b_id_"), F.col("tag").alias("b_tag_"), F.col("keep").alias("keep_"))
    d = docs.join(b, F.col("doc_id").eqNullSafe(F.col("b_id_")) & (text_tag(F.col("text")) == F.col("b_tag_")), "left")
    d = d.withColumn("lines_", split_lines(F.col("text")))
    return d.withColumn("kept_", kept_lines(F.col("lines_"), F.col("keep_")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of ``docs`` with its text less the removed lines."""
    return _with_kept(docs.select("doc_id", "text"), bitmaps).select(
        "doc_id", F.array_join("kept_", "\n").alias("text"), F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size("kept_")).cast("long").alias("n_dropped"),
    )


def filter_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less the removed lines; a null text stays null."""
    text = F.when(F.col("text").isNotNull(), F.array_join("kept_", "\n"))
    return _with_kept(docs, bitmaps).withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(docs: DataFrame, **rule) -> DataFrame:
    return apply_bitmaps(docs, line_keep_bitmaps(docs, **rule))
