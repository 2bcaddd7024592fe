"""The registered queries op1_ to op13_ and the SQL that checks them; the operators are in the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, class_lm, jaccard_join, line_dedup, mixing, nn_graph, packing, prefix_trie, quality_rules, ranked_search, repeated_phrases, simhash, token_counts,
)
from .common import documents, int_lists, record, sha

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def sha256(text):
    return F.sha2(text, 256)


SQL_LINES = (
    "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,"
    " unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {docs}),"
    " keyed AS (SELECT *, " + SQL_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + " AS key FROM lines),"
    " shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),"
    " marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)"
)
SQL_KEPT_TEXT = "coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')"


@query(
    "op1_line_dedup",
    "WITH " + SQL_LINES.format(docs="documents") + f" SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,"
    f" sha256({SQL_KEPT_TEXT}) AS kept_sha256 FROM marked GROUP BY doc_id",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir), min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(documents(spark, sf_dir), jaccard_join.Rule(words=4, percent=85))


@query("op3_mix_sources")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"))


SQL_QUALITY = (
    f"d AS (SELECT doc_id, coalesce(text, '') AS text, {SQL_WORDS} AS w FROM {{docs}}),"
    " windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),"
    " twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),"
    " covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),"
    " measured AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,"
    " length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,"
    " len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,"
    " coalesce(c.n, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines,"
    " length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),"
    " judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,"
    f" NOT ({' OR '.join(f'({r})' for r in quality_rules.RULES.values())}) AS kept FROM measured)"
)


@query(
    "op5_quality_rules",
    f"WITH {SQL_QUALITY.format(docs='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    return quality_rules.verdicts(book).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"), "kept",
    )


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def id_digests(batches):
    """Digests of the decimal ids and of the decoded bytes."""
    decimal = [str(i) for i in range(1 << 16)]
    for b in batches:
        ids = int_lists(b.column("ids"))
        joined = [sha(",".join(map(decimal.__getitem__, x)).encode()) for x in ids]
        yield record(DIGESTS, b.column("doc_id"), list(map(len, ids)), joined, list(map(sha, b.column("decoded").to_pylist())))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return byte_bpe.encode_and_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, id_digests, schema)


@query("op6_token_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = packing.byte_pair_ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=50256)
    return packing.pack(documents(spark, sf_dir), ids, capacity=4096, pad=50256)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_nn_graph")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_graph.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


@query("op9_class_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(documents(spark, sf_dir))


SQL_REPEATS = (
    f"d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),"
    " windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),"
    " firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),"
    " gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE doc_id > first),"
    " each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),"
    " kept AS (SELECT e.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL) AS text"
    " FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)"
)


@query(
    "op10_repeated_phrases",
    f"WITH {SQL_REPEATS} SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256"
    " FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = repeated_phrases.remove_repeats(documents(spark, sf_dir), n=13, finish=lambda kept: sha(kept).encode())
    return digests.withColumnRenamed("kept", "kept_sha256")


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), radius=4, words=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL_TERMS = "unnest(regexp_extract_all(" + SQL_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"


@query(
    "op12_ranked_search",
    f"WITH terms AS (SELECT doc_id, {SQL_TERMS} FROM documents), total AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM terms),"
    " sized AS (SELECT doc_id, 50 + (50 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM terms, total GROUP BY doc_id),"
    " tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),"
    " weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),"
    f" asked AS (SELECT DISTINCT item_id, {SQL_TERMS} FROM benchmark),"
    " scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score"
    " FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN sized USING (doc_id) GROUP BY ALL),"
    " ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)"
    " SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(documents(spark, sf_dir))
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


SQL_CRC32 = (
    "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)] || [-1, -1, -1, -1, -1, -1, -1, -1])),"
    " lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295)"
)


@query(
    "op13_prefix_trie",
    "WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations),"
    f" ids AS (SELECT conv_id, {SQL_CRC32} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),"
    " rebuilt AS (SELECT i.conv_id, pos, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 100 AND pos <= h"
    " UNION ALL SELECT conv_id, pos, role, text FROM ids JOIN t USING (conv_id) WHERE pos > h),"
    " seqs AS (SELECT i.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),"
    " prefixes AS (SELECT conv_id, d, s[1:d] AS p, len(s) = d AS done FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),"
    " nodes AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN length(p[d].t) ELSE 0 END AS chars,"
    " sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (done), '')) AS ends_sha256 FROM prefixes GROUP BY p, d),"
    " children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),"
    " own AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.p = n.p),"
    " sums AS (SELECT p[1:k] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved"
    " FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY 1)"
    " SELECT o.conv_id, o.depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends_sha256"
    " FROM own o JOIN sums s ON s.p = o.p LEFT JOIN own up ON o.depth > 0 AND up.p = o.p[1:o.depth - 1]",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.coded_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    trie = prefix_trie.prefix_trie(prefix_trie.rebuilt(turns, every=100, heads=6))
    none = F.sha2(F.lit(b""), 256)
    nodes = trie.nodes.filter("end_id IS NULL").withColumn("ends_sha256", none)
    nodes = nodes.unionByName(trie.nodes.filter("end_id IS NOT NULL").join(prefix_trie.end_digests(trie.ends), "end_id"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
