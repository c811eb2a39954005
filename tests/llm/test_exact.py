import pytest
from casewatch.llm import exact
from compare import connect, differences
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, row string, digest int"
ROWS = [(1, "a", "x", 1), (2, "a", "y", 2), (3, "b", "z", 3), (None, "a", "n", 4), (4, None, "e", 5), (5, "", "e", 6),
        (6, "cc", "c", 7), (6, "cc", "c", 7), (7, "A", "a", 8), (None, None, None, None), (8, "long " * 50_000, "l", 9), (9, "b", "q", 0)]


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_query_matches_sql(spark, folder):
    got = exact.op10_exact_dedup(spark, folder).toPandas()
    assert differences(got, connect(folder).sql(exact.SQL["op10_exact_dedup"]).df()) == []
    assert (got.group_size > 1).any()


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.length(t).cast("string")])
def test_odd_rows_and_weak_digests(spark, tmp_path, digest):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(str(tmp_path / "t"))
    got = exact.deduplicate_files(spark, str(tmp_path / "t"), digest=digest)
    want = brute(ROWS)
    found = got.select("row.id", "row.h1", "row.h2", "keep_id", "group_size", "kept").toPandas()
    assert len(found) == len(ROWS) and found.kept.sum() == len(want)
    sizes = sorted(found[found.kept].group_size)
    assert sizes == sorted(n for _, n in want.values())
    kept = exact.deduplicate(spark.createDataFrame(ROWS, SCHEMA), digest=digest)
    assert kept.columns == ["doc_id", "text", "row", "digest"]
    assert sorted(((r.text or "", r.doc_id) for r in kept.collect()), key=str) == sorted(((t, i) for t, (i, _) in want.items()), key=str)


def test_state_lives_on_and_empty_tables(spark, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "state")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(table)
    assert exact.deduplicate_files(spark, table, state_dir=state).filter("kept").count() == 2
    spark.createDataFrame([(3, "a")], "doc_id long, text string").write.mode("append").parquet(table)
    got = exact.deduplicate_files(spark, table, state_dir=state).filter("kept").select("row.id").toPandas()
    assert sorted(got.id) == [2, 3]
    none = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(none)
    assert exact.deduplicate_files(spark, none).count() == 0
    assert exact.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = exact.op10_exact_dedup(spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
