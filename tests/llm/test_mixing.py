import numpy as np
import pytest
from casewatch.llm import mixing


def brute_targets(sizes):
    """Shares by weight; the excess of capped sources goes to the others by weight."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: unit * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(got):
    sizes = got.groupby("source", dropna=False)["size"].sum()
    sizes = {None if isinstance(s, float) else s: int(n) for s, n in sizes.items()}
    want = brute_targets(sizes)
    for s, part in got.groupby("source", dropna=False):
        s = None if isinstance(s, float) else s
        assert part.source_size.unique().tolist() == [sizes[s]]
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= part["size"].max() / 2 + 1e-6
    assert (got.taken <= 3 * got["size"]).all()
    low = np.floor(got.target / got.source_size.clip(lower=1) + 1e-9)
    assert ((got.copies == low) | (got.copies == low + 1)).all()


def test_whole_table_and_reruns(spark, folder, documents):
    got = mixing.op3_mixing(spark, folder).toPandas()
    assert len(got) == len(documents)
    check(got)
    again = mixing.op3_mixing(spark, folder).toPandas()
    key = ["doc_id", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_many_leaves_and_levels(spark):
    docs = spark.range(9000).selectExpr(
        "id doc_id", "repeat('w ', cast(1 + id % 37 as int)) text", "case when id % 3 = 0 then null else concat('s', id % 7) end source", "1 size", "2 k")
    got = mixing.copies(docs, leaf_rows=7).toPandas()
    check(got)
    assert got.taken.sum() == pytest.approx(got["size"].sum(), rel=0.01)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.copies(spark.createDataFrame([], schema)).count() == 0
    got = mixing.copies(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).toPandas()
    assert got.target.tolist() == [0, 0] and got.taken.tolist() == [0, 0]
    got = mixing.copies(spark.createDataFrame([(None, "a b", "a")] * 4 + [(1, "x", None)], schema)).toPandas()
    check(got)


def test_expectations_are_kept():
    total = np.zeros(6)
    for seed in range(3000):
        rows = [[s, s * 77, 0.3, None] for s in (5, 9, 3, 8, 2, 7)]
        mixing.pivotal(rows, True, seed)
        total += [r[3] for r in rows]
    assert np.abs(total[:3] / 3000 - 0.3).max() < 0.06


def test_mix_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    want = {(r.doc_id): r.copies for r in mixing.copies(docs).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == want
