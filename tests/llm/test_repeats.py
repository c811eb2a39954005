import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from casewatch.llm import repeats


def brute(rows, length):
    """Count every string of every text."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(raw[p:p + length] for _, raw in raws for p in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(got):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str)


def test_whole_table(spark, folder, documents):
    got = rows_of(repeats.op4_repeated_strings(spark, folder))
    assert got == brute(list(zip(documents.doc_id, documents.text, strict=True)), 200)
    assert any(r[2] > r[3] * 200 for r in got)


def corpus():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    shared = [word(n) for n in (15, 20, 25, 60, 200)]
    rows = [(i, word(rng.randrange(40)) + rng.choice(shared) + word(rng.randrange(9)) + rng.choice(shared) + word(rng.randrange(30))) for i in range(120)]
    rows += [(500 + i, rows[i][1]) for i in range(5)] + [(7, rows[7][1]), (7, rows[7][1]), (600, None), (None, ""), (601, "a" * 300), (602, "ab" * 100), (603, shared[2][:23])]
    return rows


@pytest.mark.parametrize("hot", [16_000, 3])
def test_small_strings_and_hot_anchors(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, row int, anchor string")
    assert rows_of(repeats.remove_repeats(docs, length=24, gram=8, hot=hot, shard_bytes=2000)) == brute(rows, 24)


def test_empty_tables(spark):
    schema = "doc_id long, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "short"), (2, None)]
    assert rows_of(repeats.remove_repeats(spark.createDataFrame(rows, schema))) == brute(rows, 200)


def test_index_statistics_match_brute_force():
    rng = random.Random(9)
    for size in (1, 2, 7, 40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(size)]
        parts += parts[:2]
        ends = np.cumsum([len(p) for p in parts])
        end_of = np.repeat(ends, [len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        tails = [bytes(data[i:e]) for i, e in enumerate(end_of)]
        order = repeats.suffix_order(data, end_of)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (tails[i], i))
        index = repeats.RunIndex(data, end_of, 10**6)
        shared = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want = [max((shared(t, u) for j, u in enumerate(tails) if j != i), default=0) for i, t in enumerate(tails)]
        assert index.statistics(len(data)).tolist() == want
        assert index.runs[1].sum() == len(data) and len(index.above[0]) == len(index.runs[0])


def test_fragments_hold_every_string_once():
    texts = [bytes(random.Random(i).choice(b"abc") for _ in range(n)) for i, n in enumerate((0, 5, 23, 24, 25, 400, 90))]
    for text, (low, strings, _, _) in zip(texts, repeats.fragments(texts, 24, 8), strict=True):
        covered = [p for a, n in zip(low, strings, strict=True) for p in range(a, a + n)]
        assert covered == list(range(max(0, len(text) - 23)))
