"""Collocations against plain counting, and the trie by itself."""

import re
from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from casewatch.llm import phrases

SCHEMA = "lang string, text string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute(rows, longest=5, least=100, share=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, UPPER.lower()))):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang in totals:
        often = {p[1:]: n for p, n in counts.items() if p[0] == lang and n >= least and len(p) > 2}
        scored = []
        for p, a in often.items():
            longer = (q for q in often if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
            if any(100 * often[q] >= share * a for q in longer):
                continue
            cuts = [(1000 * a * totals[lang] // (counts[(lang, *p[:k])] * counts[(lang, *p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[(lang, *p[:k])], counts[(lang, *p[k:])]))
        out += [(lang, i, p.decode(), -a, left, r, totals[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(frame, **args):
    return sorted(tuple(r) for r in phrases.collocations(frame, **args).collect())


ROWS = [
    ("en", "New York is big. New\tYork, new york! In New York City it rains"), ("en", "a a a a a a; a a b a a b"), (None, "new york new york"),
    ("en", None), ("fr", ""), ("fr", "É é É é, à la carte à la carte. À la carte"), ("en", "x " * 20_000 + "new york"), ("en", "one\x0btwo\x0cone two\rone two one\x1ctwo"),
    ("", "new york"), ("en", "New York is big. New\tYork, new york! In New York City it rains"),
]


@pytest.mark.parametrize("args", [{"least": 2}, {"least": 3, "share": 60, "top": 3}, {"least": 2, "longest": 3, "share": 1}, {"least": 1, "longest": 4}])
def test_as_defined(spark, args):
    assert made(spark.createDataFrame(ROWS, SCHEMA).repartition(4), **args) == brute(ROWS, **args)


def test_documents(spark, folder, documents):
    rows = list(documents[["lang", "text"]].itertuples(index=False, name=None))
    got = made(spark.read.parquet(f"{folder}/documents.parquet"), least=12)
    assert got == brute(rows, least=12)
    assert len(got) > 50


def test_scores_beyond_64_bits(spark):
    """The arithmetic alone: 1000 a n passes 64 bits."""
    a, n, left, r = 3 * 10**12, 7 * 10**13, 5 * 10**12, 6 * 10**12
    row = spark.sql(f"SELECT CAST(1000 AS DECIMAL(4,0)) * CAST({a} AS DECIMAL(17,0)) * CAST({n} AS DECIMAL(17,0)) DIV (CAST({left} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))").first()
    assert row[0] == 1000 * a * n // (left * r)


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_other_columns_may_clash(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("body", "phrase", "n", "k", "a", "cut", "words", "first", "rest", "rank", "score"):
        frame = frame.withColumn(name, F.lit(1))
    assert made(frame, least=2) == brute(ROWS, least=2)


@pytest.mark.parametrize("burst", [1, 3, 1000])
def test_trie_counts_and_spills_whole_subtrees(burst):
    trie, want = phrases.PhraseTrie(burst, 50), Counter()
    runs = []
    for i in range(1, 400):
        phrase = b" ".join(b"w%d" % ((i * p) % 7) for p in (1, 3, 5, 11)[:1 + i % 4])
        trie.add("en", phrase, i)
        want[phrase] += i
        if trie.size > 50:
            runs += trie.spill(25)
            assert trie.size <= 25 and trie.size == sum(map(trie.entries, trie.roots["en"].children.values()))
    runs += trie.spill(0)
    assert trie.size == 0 and not trie.roots
    assert all(run == sorted(run) and len({p.split()[0] for p, _ in run}) == 1 for _, run in runs)
    got = Counter()
    for _, run in runs:
        got.update(dict(run))
    assert got == want


def test_runs_small_tries_give_the_same(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", F.col("text").cast("binary").alias("body"))
    few = phrases.merged(phrases.run_table(docs, 2, burst=3, most=500))
    whole = phrases.merged(phrases.run_table(docs, 2))
    assert few.exceptAll(whole).isEmpty() and whole.exceptAll(few).isEmpty()


def test_merge_is_one_exchange(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", F.col("text").cast("binary").alias("body"))
    plan = phrases.merged(phrases.run_table(docs, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


def test_query_matches_sql(spark, folder):
    actual = phrases.op13_phrases(spark, folder).toPandas()
    assert differences(actual, connect(folder).sql(phrases.SQL["op13_phrases"]).df()) == []
    assert len(actual)


@pytest.mark.parametrize("least", [2, 300])
def test_full_buckets_change_nothing(spark, monkeypatch, least):
    """With a handful of buckets, all of them full, nothing is pruned; with counts above 255, full ones are told."""
    rows = [("en", "new york is far from old york. " * 40), ("fr", "le chat noir dort. " * 310), ("en", "the cat sat on the mat " * 301)]
    want = brute(rows, least=least)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(frame, least=least) == want and want
    monkeypatch.setattr(phrases, "LEAST_BUCKETS", 64)
    monkeypatch.setattr(phrases, "MOST_BUCKETS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    assert made(frame, least=least) == want


def test_rare_pairs_are_not_counted_by_name(spark):
    rows = [("en", " ".join(f"w{i}_{j}" for j in range(200)) + ". common pair here") for i in range(200)]
    texts = spark.createDataFrame(rows, SCHEMA).select("lang", F.col("text").cast("binary").alias("body"))
    word_bits, pair_bits, totals = phrases.bucket_filters(texts, 2**20, 2**22, 100)
    both = phrases.candidates(texts, word_bits, pair_bits)
    assert totals.first()["words"] == 200 * 203
    assert both.filter("phrase IS NOT NULL").select("phrase").distinct().count() == 3
    assert sum(len(r.body.split(b"\n")) for r in both.filter("body IS NOT NULL").collect()) == 200


def test_rare_longer_phrases_are_not_counted_by_name(spark):
    """Frequent words and pairs whose phrases of three words are rare, but for one."""
    rows = [("en", f"a{i % 20} b{i // 20 % 20} c{(i + i // 20) % 20}. all three here") for i in range(4000)]
    texts = spark.createDataFrame(rows, SCHEMA).select("lang", F.col("text").cast("binary").alias("body")).repartition(3)
    every = phrases.merged(phrases.run_table(texts, 3))
    named = phrases.merged(phrases.run_table(texts, 3, bits=phrases.gram_filter(texts, 3, 2**20, 100)))
    assert every.count() == 401
    assert [tuple(r) for r in named.collect()] == [("en", b"all three here", 4000)]


def test_rows_counted_by_name_follow_phrases_not_splits(spark, monkeypatch):
    """Every split holds every word; the rows of all counting passes are words by cores, not by splits."""
    sizes = {}
    texts = spark.createDataFrame([("en", " ".join(f"w{i}" for i in range(500)))] * 128, SCHEMA)
    seen = phrases.merged
    for parts in (8, 64):
        held = []
        monkeypatch.setattr(phrases, "merged", lambda runs, held=held: held.append(runs.count()) or seen(runs))
        frame = texts.repartition(parts).select("lang", F.col("text").cast("binary").alias("body"))
        assert phrases.frequent_phrases(frame)[0].count() == 500 + 499 + 498 + 497 + 496
        sizes[parts] = held
    assert len(sizes[64]) == 5 and all(n <= 8 * 500 for n in sizes[64])


def test_bucket_of_a_phrase_ends_with_its_piece():
    buckets = phrases.Buckets(1, 2**16)
    tokens, starts, at = buckets.grams("en", b"a b c" + phrases.MARK + b"a b c d", 3)
    assert [tokens[i:i + 3] for i in starts] == [[b"a", b"b", b"c"], [b"a", b"b", b"c"], [b"b", b"c", b"d"]]
    assert at[0] == at[1] != at[2]
    assert [len(x) for x in buckets.grams("en", b"a b", 3)] == [2, 0, 0]
