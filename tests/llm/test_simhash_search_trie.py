"""SimHash, ranked search and the prefix trie against plain versions on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import nn_graph, prefix_trie, ranked_search, simhash

CLASH = ("fp", "group", "seg", "key", "h1", "n", "m", "item", "pos", "ids", "chars", "end_id", "slice", "terms")


def vocabulary(rng, n=300):
    return ["".join(rng.choice("abcdéfgXYZ0#") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def make_rows():
    rng = random.Random(5)
    v = vocabulary(rng)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, say(rng.randint(5, 80))) for i in range(60)]
    for i in range(60, 120):  # near copies of long and of short texts
        words = rows[i % 20][1].split(" ") * (1 + i % 3)
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(120 + i, rows[3][1]) for i in range(10)]
    rows += [(130 + i, t) for i, t in enumerate([None, "", " \n\t ", "one", "ONE", "two words", "#$ %%", "x" * 5000, "日本語 テキスト\n½ é", "a\x00b\x7fc d-d"])]
    rows += [(200, say(30_000)), (None, rows[0][1]), (None, rows[0][1]), (7, rows[8][1]), (7, rows[8][1]), (-5, rows[9][1])]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    return d.withColumns({c: F.lit("x") for c in CLASH}).cache()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text, words=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return [first.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_near_duplicates_are_the_components_of_all_close_pairs(docs, radius):
    fps = [plain_fingerprint(t) for _, t in ROWS]
    want = Counter((r[0], f, c) for r, f, c in zip(ROWS, fps, plain_components(ROWS, fps, radius)))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, radius=radius).collect())
    assert got == want
    assert len({c for _, _, c in got}) < len(set(fps)) or radius == 0


def test_long_text_is_hashed_in_blocks_like_a_whole(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500)).encode()
    whole = simhash.fingerprint(text, 4, 42)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text, 4, 42) == whole == plain_fingerprint(text.decode()) - (1 << 64) * (plain_fingerprint(text.decode()) >> 63)


@pytest.mark.parametrize("n", [1, 10**5, 10**7, 10**9])
def test_segments_cover_the_fingerprint_and_miss_no_distance(n):
    for radius in range(1, 9):
        plan = simhash.segment_plan(n, radius)
        assert [a for a, _, _ in plan] == list(np.cumsum([0, *(w for _, w, _ in plan)])[:-1]) and sum(w for _, w, _ in plan) == 64
        assert sum(r for _, _, r in plan) == radius + 1 - len(plan)  # one bit more in each segment is over the radius
        assert any(r for _, _, r in plan)


@pytest.mark.parametrize("n", [10**3, 10**7, 10**12])
def test_close_pairs_are_whole_for_every_plan(spark, n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    plan = simhash.segment_plan(n, 4)
    d = spark.createDataFrame([(s, s % 5) for s in signed], "fp long, group long")
    got = [(r.fp, r.fp_b) for r in simhash.close_pairs(d, plan, 4).collect()]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a % 5 != b % 5 and bin((a ^ b) % (1 << 64)).count("1") <= 4}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_large_group_of_close_fingerprints_gives_links_and_no_pairs_within(spark):
    """4,096 fingerprints in one cube of 12 bits, one of them three bits from a far group: one bit at a time joins the cube."""
    cube = spark.range(4096).select(F.col("id").alias("fp"))
    links = simhash.one_bit_pairs(cube)
    assert links.count() == 4096 * 12 / 2
    nodes = cube.withColumn("group", F.lit(0).cast("long")).union(spark.createDataFrame([(7 << 40, 1)], "fp long, group long"))
    found = simhash.close_pairs(nodes, simhash.segment_plan(4097, 4), 4).collect()
    assert len(found) == 1 + 12  # the corner 0 and its 12 neighbours


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain_search(rows, items, k):
    found = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = Counter()
    for key, text in items:
        scored = []
        for doc_id, c in found:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out.update((key, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1))
    return out


ITEMS = [(i, " ".join(ROWS[i][1].split(" ")[:12])) for i in range(20)] + [(90, None), (91, ""), (92, "unheard of"), (93, ROWS[3][1]), (93, ROWS[4][1]), (None, "CHANGED changed"), (94, "日本語 ½")]


@pytest.mark.parametrize(("k", "postings", "items"), [(5, 200_000, 512), (3, 60, 4), (1000, 500, 512), (50, 1, 1)])
def test_search_equals_scoring_everything(spark, docs, monkeypatch, k, postings, items):
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "PASS_ITEMS", items)
    asked = ITEMS if items > 4 else ITEMS[:3] + ITEMS[-4:]
    index = ranked_search.build_index(docs)
    queries = spark.createDataFrame(asked, "item_id long, text string").withColumn("rank", F.lit("x"))
    got = ranked_search.search(index, queries, k=k).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == plain_search(ROWS, asked, k)


def test_index_holds_every_document_once_in_strata(docs):
    index = ranked_search.build_index(docs)
    want = [(i, Counter(terms(t))) for i, t in ROWS if terms(t)]
    assert (index.n_docs, index.n_terms) == (len(want), sum(sum(c.values()) for _, c in want))
    got = Counter()
    for b in index.blocks.collect():
        for t, term in enumerate(b.terms):
            groups = range(b.term_ends[t - 1] if t else 0, b.term_ends[t])
            assert [b.tfs[g] for g in groups] == sorted({b.tfs[g] for g in groups})
            for g in groups:
                got.update((b.docs[x], term, b.tfs[g]) for x in b.members[b.tf_ends[g - 1] if g else 0 : b.tf_ends[g]])
    assert got == Counter((i, t, n) for i, c in want for t, n in c.items())


def turns():
    rng = random.Random(9)
    said = [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "é½", "yes", "a longer answer", "x" * 3000])) for _ in range(8)]
    rows = []
    for c in [*range(0, 60), *range(90, 130), 205, 377, -1, -250, 10**15]:
        n = rng.randint(0, 9) if c % 100 else rng.randint(0, 4)
        path = [rng.choice(said[:2]) for _ in range(n)] if c % 3 else [said[k % 8] for k in range(n)]
        rows += [(c, t if t else None, *x) for t, x in enumerate(path)]
    rows += [(400, t, "user", "same") for t in (3, 3, None, None, 1)]  # ties and nulls in turn, equal turns
    rows += [(c, 0, "user", "common") for c in range(500, 700)]  # one sequence that most share
    rows += [(None, 0, "user", "nobody"), (None, 1, "user", "nobody")]
    rng.shuffle(rows)
    return rows


TURNS = turns()


def plain_sequences(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        out[c] = tuple(own.get(base, [])[:h] + v[h:])
    return out


def plain_nodes(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    below = defaultdict(set)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    out = Counter()
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        done = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        up = min(members[p[:-1]]) if p else None
        out[(min(m), len(p), up, len(m), len(below[p]), sum(not below[q] for q in inside), saved, hashlib.sha256(done.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("tree", "chunk", "tasks"), [(500_000, 1 << 16, 2), (1, 1, 7), (7, 3, 4)])
def test_trie_equals_counting_every_prefix(spark, monkeypatch, tree, chunk, tasks):
    monkeypatch.setattr(prefix_trie, "TREE_TURNS", tree)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "shuffle_tasks", lambda spark: tasks)
    d = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(4)
    d = d.withColumns({c: F.lit("x") for c in CLASH})
    trie = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.coded_turns(d)))
    digests = {r.end_id: r.ends_sha256 for r in prefix_trie.end_digests(trie.ends).collect()}
    digests[None] = hashlib.sha256(b"").hexdigest()
    got = Counter(
        (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests[r.end_id]) for r in trie.nodes.collect()
    )
    assert got == plain_nodes(plain_sequences(TURNS))


def test_ternary_tree_stays_flat_and_deep_tries_need_no_recursion():
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians_first(4096):
        tree.insert([i], [1], 1, i)

    def height(v):
        return 1 + max(height(tree.low[v]), height(tree.high[v])) if v else 0

    assert height(tree.down[0]) == 13
    deep = prefix_trie.TernaryTree()
    deep.insert(list(range(50_000)), [1] * 50_000, 3, 1)
    assert [x[0] for x in deep.totals()] == [1, 1, 100_000]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).collect() == []
    index = ranked_search.build_index(none)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert index.n_docs == 0 and ranked_search.search(index, items).collect() == []
    assert ranked_search.search(ranked_search.build_index(docs), items.limit(0)).collect() == []
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    trie = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.coded_turns(empty)))
    assert trie.nodes.collect() == [] and prefix_trie.end_digests(trie.ends).collect() == []


def clustered(rng, n, dim):
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("norms", ["outlier", "lognormal", "wide", "beyond float"])
def test_neighbours_are_found_whatever_the_norms(spark, norms):
    rng = np.random.default_rng(3)
    x = clustered(rng, 1500, 24)
    scale = {
        "outlier": np.where(np.arange(1500) == 77, 10_000.0, 1.0), "lognormal": np.exp(rng.normal(0, 1, 1500)),
        "wide": 10.0 ** rng.uniform(-6, 6, 1500), "beyond float": np.where(np.arange(1500) % 50 == 7, 1e120, 1e-30),
    }[norms]
    x = x * scale[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    settings = nn_graph.Settings(few=50, block=24 * 8 * 30)  # several graphs, and small bands in several blocks
    got = defaultdict(list)
    for r in nn_graph.nearest(d, settings=settings).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(np.isclose(v, s[i], rtol=1e-12) for _, i, v in rows)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(rows, rows[1:]))
        hits += len(best & {i for _, i, _ in rows})
    assert hits / (75 * 20) >= 0.9
