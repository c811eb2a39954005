import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from casewatch.llm import toxic


def brute_marginals(odds, first, a):
    """Sum over all state sequences of each text."""
    out, pairs = [], np.zeros((2, 2))
    starts = [*np.flatnonzero(first), len(odds)]
    for s, e in itertools.pairwise(starts):
        total, p, q = 0.0, np.zeros(e - s), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=e - s):
            w = np.exp(sum(odds[s + i] * z for i, z in enumerate(states)) + sum(a[x, y] for x, y in itertools.pairwise(states)))
            total += w
            p += w * np.array(states)
            for x, y in itertools.pairwise(states):
                q[x, y] += w
        out += list(p / total)
        pairs += q / total
    return np.array(out), pairs


@pytest.mark.parametrize("sizes", [[1], [5], [3, 1, 7], [2, 9, 1, 1, 4]])
def test_forward_backward_matches_enumeration(sizes):
    rng = np.random.default_rng(len(sizes))
    odds, a = rng.normal(0, 2, sum(sizes)), rng.normal(0, 1, (2, 2))
    first = toxic.firsts(np.array(sizes))
    p, pairs = toxic.chain(odds, first, a)
    want, want_pairs = brute_marginals(odds, first, a)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    got = toxic.op6_toxicity(spark, folder).toPandas()
    docs, labels = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/labels.parquet")
    return got, docs, got.merge(labels, on="doc_id")


INSULTS = {"trash", "pathetic", "worthless", "idiot", "disgusting", "loser", "scum", "moron", "clown", "stupid"}


def test_held_out_documents(scored):
    got, docs, both = scored
    assert len(got) == len(docs)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    rude = {i for i, t in zip(docs.doc_id, docs.text, strict=True) if INSULTS & {w.strip(".,").lower() for w in t.split()}}
    out = both[both.held_out]
    told = out[out.predicted == 1]
    assert (told.toxic == 1).mean() > 0.95
    learned = set(both[~both.held_out].doc_id)
    plain = got[got.doc_id.isin(rude - learned)]
    assert len(plain) > 5 and (plain.predicted == 1).mean() > 0.9


def test_spans_point_at_words(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(50)] + ["an", "yes", "quiet", "a", "day"]
    texts, labels = [], []
    for i in range(300):
        words = rng.choices(plain, k=20)
        if i % 2:
            words[rng.randrange(20)] = rng.choice(["idiot", "clown"])
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = toxic.fit(texts, np.array(labels), 0.3)
    rows = [(1, "An  IDIOT, yes", "x"), (2, None, "x"), (3, "", None), (None, "a quiet day", "x"), (4, "quiet " * 60_000 + "clown", "x"), (4, "idiot idiot", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = toxic.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, len(r.spans)): r for r in got}
    assert [tuple(s)[:2] for s in by[1, 1].spans] == [(4, 10)]
    assert [tuple(s)[:2] for s in by[4, 1].spans] in ([(360_000, 360_005)], [(0, 11)])
    assert by[2, 0].score == by[3, 0].score < 0.5 < by[1, 1].score
    assert toxic.score(docs.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 0.01 for r in toxic.score(docs, toxic.train(docs, none)).collect()} == {True}
    odd = spark.createDataFrame([(1, 0, 1), (None, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert toxic.score(docs, toxic.train(docs, odd)).count() == 2


def test_slices_go_by_size_and_hold_long_texts(spark):
    import pyarrow as pa

    from casewatch.llm import common

    texts = pa.array(["a" * 10, "b" * 60, None, "c" * 200, "", "d", "é" * 30])
    assert list(common.slices(texts, 3, 70)) == [(0, 3), (3, 1), (4, 3)]
    assert list(common.slices(texts, 2, 10**9)) == [(0, 2), (2, 2), (4, 2), (6, 1)]
    assert list(common.slices(texts.slice(3, 1), 2, 1)) == [(0, 1)] and list(common.slices(texts[:0], 5, 5)) == []


def test_slices_change_no_score(spark, folder, documents, monkeypatch):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxic.train(docs, labels.withColumn("text", toxic.F.lit("x")).withColumn("t", toxic.F.lit(1)))
    few = docs.limit(40).withColumn("t", toxic.F.lit("y")).withColumn("score", toxic.F.lit("z"))
    long = spark.createDataFrame([(10**6, " ".join(documents.text[:100]) * 3)], "doc_id long, text string")
    rows = few.unionByName(long, allowMissingColumns=True)
    whole = {r.doc_id: r.score for r in toxic.score(rows, model).collect()}
    one = toxic.score(rows.select("doc_id", "text").repartition(1), model)
    assert {r.doc_id: round(r.score, 6) for r in one.collect()} == {k: round(v, 6) for k, v in whole.items()}
    assert len(whole) == 41
