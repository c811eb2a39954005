"""Line deduplication against a dictionary, with filters of all sizes."""

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from casewatch.llm import bloom, lines

SCHEMA = "doc_id long, text string"
LINE, OTHER = "A line that Many documents hold", "Überall dieselbe Zeile hier"


def brute(rows, least_chars=20, least_docs=3):
    table = str.maketrans(lines_upper, lines_upper.lower())
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(table)
    held: dict[str, list] = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append(-1 if doc is None else doc)
    gone = {k: max(docs) for k, docs in held.items() if len(docs) >= least_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if gone.get(key(x), -1 if doc is None else doc) == (-1 if doc is None else doc)]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


lines_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS = [
    (1, f"{LINE}\nshort\n{OTHER}\nonly here, in this one document"), (2, f"  {LINE.upper()}\t\nshort\n"), (3, f"{LINE}\n{LINE}\n{OTHER} "),
    (4, None), (5, ""), (6, f"{OTHER}\r\nshort"), (6, f"{OTHER}\n{LINE}"), (None, f"{LINE}\nx"), (None, f"{LINE}\nx"),
    (7, "twice in two documents only"), (8, "twice in two documents only\n" + "\n" * 50), (9, "y" * 400_000 + f"\n{LINE}\n" + "z " * 100_000),
    (10, "ÄÖÜ zwanzig Zeichen."), (11, "ÄÖÜ zwanzig Zeichen."), (12, "ÄÖÜ zwanzig Zeichen."), (13, "äöü zwanzig zeichen."), (14, "ÄÖÜ neunzehn Zeich."), (15, "ÄÖÜ neunzehn Zeich."),
    (16, "ÄÖÜ neunzehn Zeich."),
]


def made(frame, **args):
    return sorted((tuple(r) for r in lines.drop_repeated_lines(frame, **args).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("args", [{}, {"least_docs": 2, "least_chars": 1}, {"least_docs": 5}])
def test_as_defined(spark, parts, args):
    assert made(spark.createDataFrame(ROWS, SCHEMA).repartition(parts), **args) == brute(ROWS, **args)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_BITS", 64)
    frame = spark.createDataFrame([*ROWS, *((100 + i, f"line number {i} of its own document") for i in range(300))], SCHEMA)
    assert made(frame, most_bits=64) == brute([tuple(r) for r in frame.collect()])


def test_few_lines_are_suspected(spark):
    """Of lines that stand once, nearly none leaves the scan."""
    rows = [(i, "\n".join(f"line {i} {j} that nobody else has" for j in range(20))) for i in range(500)]
    frame = spark.createDataFrame([*rows, (900, LINE), (901, LINE)], SCHEMA).select("doc_id", F.col("text").cast("binary").alias("body"))
    hashes = lines.hash_table(frame.repartition(6), 20)
    words = bloom.size_for(10_002, lines.BITS_A_KEY, lines.LEAST_BITS, lines.MOST_BITS)
    twice = bloom.from_blocks(lines.filter_blocks(hashes, words), words, "twice")
    keyed = frame.select(F.struct(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")).alias("k"), "body")
    met = lines.suspects(keyed, twice, 20)
    assert met.filter("k.id >= 900").count() == 2
    assert met.count() < 20


def test_filters_hold_what_was_added():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    once, twice = np.zeros(2**14, np.uint64), np.zeros(2**14, np.uint64)
    bloom.add_twice(once, twice, hashes[:10_000])
    assert bloom.holds(once, hashes[:10_000]).all()
    bloom.add_twice(once, twice, hashes[5_000:15_000])
    assert bloom.holds(twice, hashes[5_000:10_000]).all()
    assert bloom.holds(twice, hashes[15_000:]).mean() < 0.01


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_other_columns_may_clash(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("k", "body", "line", "gone", "n", "keeper", "hashes"):
        frame = frame.withColumn(name, F.lit(1))
    assert made(frame) == brute(ROWS)


def test_one_document_is_no_repeat(spark):
    with pytest.raises(ValueError, match="two"):
        lines.drop_repeated_lines(spark.createDataFrame(ROWS, SCHEMA), least_docs=1)


def test_query_matches_sql(spark, folder):
    actual = lines.op12_line_dedup(spark, folder).toPandas()
    assert differences(actual, connect(folder).sql(lines.SQL["op12_line_dedup"]).df()) == []
    assert actual.n_dropped.sum() > 0
