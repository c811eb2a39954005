from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from casewatch.llm import common, quality
from pyspark.sql import functions as F
from test_forest import brute as classes_of
from test_mixing import brute_targets


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        before = docs
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before.toPandas(), docs.toPandas()
    return out


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert len(after)
        if name != "sequence_packing":
            assert list(after.columns) == list(before.columns)
            assert (after.n_chars == after.text.str.len()).all()


def test_quality_rules_keep_what_passes(stages):
    before, after = stages["quality_rules"]
    lines = Counter()
    for host, text in before[["source", "text"]].drop_duplicates().values:
        lines.update({(host, quality.normal_line(x.encode())) for x in text.split("\n") if x.strip()})
    want = {}
    for r in before.itertuples():
        n_words, *_, repeated = quality.measure(r.text, common.WordHashes())[:5]
        normal = quality.normal_line
        often = [x for x in r.text.split("\n") if len(normal(x.encode()).decode()) >= 20 and lines[r.source, normal(x.encode())] > 5]
        lost = sum(len(x.encode().split()) for x in often)
        if n_words >= 50 and 100 * repeated <= 50 * n_words and lost <= 0.5 * n_words and n_words - lost >= 50:
            want[r.doc_id] = "\n".join(x for x in r.text.split("\n") if x not in often)
    assert dict(zip(after.doc_id, after.text, strict=True)) == want


def test_exact_dedup_keeps_the_largest(stages):
    before, after = stages["exact_dedup"]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())


def test_one_of_each_near_class_stays(stages):
    before, after = stages["ngram_jaccard"]
    cls, _ = classes_of(list(zip(before.doc_id, before.text, strict=True)))
    best = defaultdict(int)
    for i, t in zip(before.doc_id, before.text, strict=True):
        best[cls[t]] = max(best[cls[t]], i)
    assert sorted(after.doc_id) == sorted(best.values())


def test_mix_comes_near_its_targets(stages):
    before, after = stages["source_mixing"]
    size = {i: len(t.encode().split()) for i, t in zip(before.doc_id, before.text, strict=True)}
    sizes, largest = Counter(), Counter()
    for i, s in zip(before.doc_id, before.source, strict=True):
        sizes[s] += size[i]
        largest[s] = max(largest[s], size[i])
    taken = Counter()
    for i, s in zip(after.doc_id, after.source, strict=True):
        taken[s] += size[i]
    for s, goal in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - goal) <= largest[s] / 2 + 1e-6


def test_packing_and_run(stages, spark, folder):
    before, after = stages["sequence_packing"]
    copies = Counter(before.doc_id)
    once = after[after.doc_id.map(copies) == 1]
    check_packing_of_singles(once, before[before.doc_id.map(copies) == 1])
    assert after.length.sum() == sum(after.drop_duplicates("doc_id").set_index("doc_id").doc_tokens[i] * n for i, n in copies.items())
    again = corpus_pipeline.run(spark, folder).toPandas()
    assert Counter(map(tuple, again[["doc_id", "doc_tokens"]].drop_duplicates().values)) == Counter(map(tuple, after[["doc_id", "doc_tokens"]].drop_duplicates().values))
    assert again.length.sum() == after.length.sum()


def check_packing_of_singles(rows, docs):
    for i, group in rows.sort_values("start").groupby("doc_id"):
        assert group.start.tolist() == [0, *group.length.cumsum()[:-1]]
        assert group.length.sum() == group.doc_tokens.iloc[0]
    assert set(rows.doc_id) == set(docs.doc_id)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, ties, a very long text, columns that clash with the operators' own."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words, None, None, None), (None, words + " more", "en", "a", 1), (3, None, None, None, None),
            (4, "", "en", "a", 0), (5, "short", "en", "b", 5), (6, "long text " * 30_000 + words, "en", "b", 9), (7, f"{words} x y z", "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("k", "host", "node", "hub", "row", "digest", "size", "removed", "kept"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def test_stages_on_odd_rows_and_empty_tables(spark, odd, folder):
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, folder)
        assert name == "sequence_packing" or made.columns == odd.columns
        assert made.count() > 0
        assert stage(spark, odd.limit(0), folder).count() == 0
