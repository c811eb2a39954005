import random
from collections import Counter, defaultdict

import pytest
from casewatch.llm import forest
from casewatch.llm.components import components


def brute(rows, threshold=0.8):
    """Classes and links by comparing all texts that share a shingle."""
    sets = {}
    for _, t in rows:
        w = [x for x in (t or "").replace("\n", " ").split(" ") if x]
        n = min(5, len(w))
        sets[t or ""] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    holds = defaultdict(list)
    for t, s in sets.items():
        for g in s:
            holds[g].append(t)
    shared = Counter((a, b) for ts in holds.values() for a in ts for b in ts if a < b)
    links, parent = Counter(), {t: t for t in sets}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    return {t: root(t) for t in sets}, links


def check(got, rows):
    cls, links = brute(rows)
    members = defaultdict(list)
    for i, t in rows:
        members[cls[t or ""]].append(i)
    copies = Counter(t or "" for _, t in rows)
    want = sorted((i, max(members[cls[t or ""]]), len(members[cls[t or ""]]), copies[t or ""], links[t or ""]) for i, t in rows)
    cols = ["doc_id", "class_id", "class_size", "n_copies", "n_links"]
    assert sorted(map(tuple, got[cols].values.tolist())) == want


def test_query_matches_brute_force(spark, folder, documents):
    got = forest.op9_ngram_jaccard(spark, folder).toPandas()
    check(got, list(zip(documents.doc_id, documents.text, strict=True)))
    assert (got.n_links > 0).any()


def variants(n, edits, length=120, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.random():.6f}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"x{rng.random():.6f}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [7, 512])
def test_hot_group_in_blocks(spark, block):
    rows = list(enumerate(variants(60, 3) + ["short text", "short text", "other short text", "one"] + ["same " * 9] * 3 + variants(5, 9, seed=8)))
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, node int, labels string")
    check(forest.near_duplicates(docs, block=block).toPandas(), rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert forest.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, ""), (4, " \n")]
    got = {(r.doc_id, r.class_id, r.class_size) for r in forest.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 1, 3), (1, 1, 3), (2, 3, 2), (3, 3, 2), (4, 4, 1)}


def test_one_of_each_class_stays(spark):
    rows = list(enumerate(variants(20, 2) + ["alone in here"]))
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").select("text", "doc_id")
    got = forest.keep_one(docs)
    assert got.columns == docs.columns
    cls, _ = brute(rows)
    best = {}
    for i, t in rows:
        best[cls[t]] = max(best.get(cls[t], -1), i)
    assert sorted(r.doc_id for r in got.collect()) == sorted(best.values())


def test_prefix_is_shortened_to_the_recall():
    assert forest.prefix_depth(24, 8, 0.8, 0.9999) == 5
    assert forest.prefix_depth(24, 8, 0.8, 0.5) == 8
    assert forest.prefix_depth(2, 8, 0.8, 0.9999) == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    chain = list(range(100))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(200, i) for i in range(201, 240)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(100)} | {i: 200 for i in range(200, 240)} | {300: 300, 301: 300}


def test_crowded_prefixes_keep_their_branches(spark):
    """Nodes under one prefix: few make one leaf, many are told apart by the rest of their labels."""
    step = forest.STEP
    rows = [(i, 0, 7, ((i % 3) << (2 * step)) | ((i % 2) << step)) for i in range(12)] + [(100 + i, 0, 8, i << (2 * step)) for i in range(3)]
    labels = spark.createDataFrame(rows, "node long, tree int, prefix long, rest long")
    few = {(r.node, r.hub) for r in forest.memberships(labels, 3, 2, dense=12).collect()}
    assert few == {(i, 0) for i in range(12)} | {(100 + i, 100) for i in range(3)}
    one = {(r.node, r.hub) for r in forest.memberships(labels, 3, 1, dense=5).collect()}
    assert one == {(i, i % 3) for i in range(12)} | {(100 + i, 100) for i in range(3)}
    two = {(r.node, r.hub) for r in forest.memberships(labels, 3, 2, dense=3).collect()}
    assert two == {(i, i % 6) for i in range(12)} | {(100 + i, 100) for i in range(3)}


def test_pairs_still_share_a_hub_after_hubs_hand_over(spark):
    rng = random.Random(2)
    rows = [(n, h, rng.randrange(1, 9)) for n in range(60) for h in rng.sample(range(n + 1), min(n + 1, 3))]
    rows = list({(n, h): (n, h, t) for n, h, t in rows + [(h, h, 5) for _, h, _ in rows]}.values())

    def pairs(found):
        own = defaultdict(set)
        for n, h in found:
            own[h].add(n)
        return {(a, b) for ns in own.values() for a in ns for b in ns if a < b}

    held = spark.createDataFrame(rows, "node long, hub long, trees long")
    before = pairs((n, h) for n, h, _ in rows)
    for hops in (1, 2):
        after = [(r.node, r.hub) for r in forest.handed_over(held, 4, hops).collect()]
        assert before <= pairs(after) and len(after) == len(set(after)) < len(rows)


def test_recall_at_the_threshold(spark, folder):
    """Pairs near 0.8 in crowded and in sparse prefixes against brute force."""
    rng = random.Random(11)
    rows = []
    for g in range(150):
        words = [f"g{g}_{rng.random():.8f}" for _ in range(124)]
        rows.append(" ".join(words))
        for at in rng.sample(range(0, 120, 6), 2):  # two words apart: ten shingles of 120 differ
            words[at] = f"x{rng.random():.8f}"
        rows.append(" ".join(words))
    rows += variants(80, 2, length=90, seed=4)
    rows = list(enumerate(rows))
    _, links = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = forest.near_duplicates(docs, dense=4).agg({"n_links": "sum"}).first()[0]
    assert sum(links.values()) > 500
    assert got >= 0.99 * sum(links.values())


def test_hubs_do_not_chain(spark):
    """A chain of texts, each half like the next: groups stay small, nothing is linked."""
    words = [f"c{i}" for i in range(60 * 40)]
    rows = [(i, " ".join(words[30 * i:30 * i + 60])) for i in range(78)]
    got = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_links == 0 and r.class_size == 1 for r in got)


@pytest.mark.parametrize("block_bytes", [300, 2**23])
def test_groups_are_bounded_by_bytes_and_long_texts(spark, block_bytes):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = list(enumerate([*variants(20, 2), long, long + " more", "é " * 30]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hub", forest.F.lit(1)).withColumn("hubs", forest.F.lit("x"))
    check(forest.near_duplicates(docs, block_bytes=block_bytes).toPandas(), rows)
