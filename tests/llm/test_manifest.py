"""The manifest against a plain recursive tree, and proofs that find what was changed."""

import hashlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from casewatch.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests, fan):
    """Root of a list of digests and each one's siblings, bottom up."""
    above = [[] for _ in digests]
    held = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [(digests[i:i + fan], held[i:i + fan]) for i in range(0, len(digests), fan)]
        for own, members in runs:
            for slot, ids in enumerate(members):
                for i in ids:
                    above[i].append(own[:slot] + own[slot + 1:])
        digests, held = [h(*own) for own, _ in runs], [[i for m in members for i in m] for _, members in runs]
    return digests[0], above


def brute(rows, fan):
    """Sorted (leaf, subroot, root, siblings of all levels) by the definition."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        groups.append(([leaf(r) for r in own], *tree([leaf(r) for r in own], fan)))
    root, tops = tree([g[1] for g in groups], fan)
    return sorted((d, sub, root, "".join(s for step in path + top for s in step))
                  for (leaves, sub, paths), top in zip(groups, tops, strict=True) for d, path in zip(leaves, paths, strict=True))


def made(frame, fan):
    rows = manifest.manifest(frame, fan=fan)
    flat = rows.select("leaf", "subroot", "root", F.concat_ws("", F.flatten("steps.siblings")))
    return sorted(tuple(r) for r in flat.collect())


ROWS = [(i, f"s{i % 3}", lang, i, "Text É\n" * (i % 4)) for lang, n in (("en", 21), ("de", 8), ("fr", 1), ("", 3), (None, 9)) for i in range(n)]
ROWS += [(None, None, "en", None, None), (None, None, "en", None, None), (5, "s2", "en", 5, "Text É\n"), (7, None, "ü", None, ""), (8, "x", "en", 2, "a" * 300_000)]


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_as_defined(spark, fan):
    assert made(spark.createDataFrame(ROWS, SCHEMA).repartition(5), fan) == brute(ROWS, fan)


@pytest.mark.parametrize("rows", [ROWS[:1], ROWS[:8], ROWS[:9], [r for r in ROWS if r[2] in ("fr", "ü")]])
def test_small_trees(spark, rows):
    assert made(spark.createDataFrame(rows, SCHEMA), 8) == brute(rows, 8)


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA), 8) == []


def test_other_columns_may_clash(spark):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    others = plain
    for name in ("tree", "place", "left", "digest", "steps", "root", "grp", "_row", "slot"):
        others = others.withColumn(name, F.lit("x"))
    assert made(others, 8) == brute(ROWS, 8)


def test_a_changed_leaf_misses_the_root(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    rows = manifest.manifest(frame, carry={"doc_id": F.col("doc_id")})
    assert manifest.verified(rows).filter("NOT verified").isEmpty()
    assert manifest.verified(rows, F.sha2("leaf", 256)).filter("verified").isEmpty()


def test_fan_of_one_is_refused(spark):
    with pytest.raises(ValueError, match="two children"):
        manifest.manifest(spark.createDataFrame(ROWS, SCHEMA), fan=1)


def test_no_window_over_rows_and_no_text_shuffled(spark, folder):
    rows = manifest.op11_manifest(spark, folder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_query_matches_sql(spark, folder):
    actual = manifest.op11_manifest(spark, folder).toPandas()
    assert differences(actual, connect(folder).sql(manifest.SQL["op11_manifest"]).df()) == []
    assert 0 < actual.verified.sum() < len(actual)
