import re

from casewatch.llm import license as scan
from casewatch.llm.signatures import CONFIDENCE, HINTS, RULES, Rule

COMPILED = [(i, r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for i, r in enumerate(RULES)]
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def brute(text):
    text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    canon = f" {' '.join(words)} "
    hits = []
    for i, r, pattern in COMPILED:
        for m in pattern.finditer(canon):
            a = canon[:m.start()].count(" ") - 1
            hits.append((a, a + m[0].count(" ") + 1, r.priority, i, r.label))
    stay = [h for h in hits if not any(
        g != h and g[0] <= h[0] and g[1] >= h[1] and (g[2] > h[2] or g[2] == h[2] and (g[:2] != h[:2] or g[3] < h[3])) for g in hits)]
    score = max([CONFIDENCE[h[2]] for h in stay] + ([0.6] if labels else [0.0]))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {h[4] for h in stay})), score, len(stay))


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found"]


def check(got, rows):
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in got.collect()), key=str) == want


def test_query_matches_brute_force(spark, folder, documents):
    got = scan.op8_license_scan(spark, folder)
    check(got, zip(documents.doc_id, documents.text, strict=True))
    assert got.filter("labels <> ''").count() > 0


def test_written_texts(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the \"License\")", "MIT License\nMIT License mit-license", "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License v2 or later; GNU Lesser General Public License version 2.1", "CC BY-NC-SA 4.0 and cc-by 3.0", None, "", " .,", "x",
        "MIT", "é mit license ß", "Permission is hereby granted, free of charge, to any person obtaining a copy\n" * 50, "mit license " * 3000,
        "All rights reserved. Copyright (c) 2021 X", "generalpublic license general public\tlicense", "the Apache License Apache License",
    ]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, found int")
    check(scan.scan(docs), enumerate(texts))
    found = {r.label for r in scan.spans(docs).filter("doc_id = 0").collect()}
    assert found == {"apache-2.0"}


def test_repeats_nulls_empty(spark):
    schema = "doc_id long, text string"
    assert scan.scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "mit license"), (1, "bsd license"), (1, "bsd license")]
    check(scan.scan(spark.createDataFrame(rows, schema)), rows)


def test_priority_and_containment(spark):
    rules = [Rule("low", "a b c d", [], 1), Rule("inside", "b c", [], 1), Rule("higher", "c d", [], 2), Rule("same", "a b c d", [], 1)]
    got = scan.spans(spark.createDataFrame([(1, "license a b c d")], "doc_id long, text string"), rules=rules)
    assert {(r.label, r.start, r.end) for r in got.collect()} == {("low", 1, 5), ("higher", 3, 5)}


def test_hints_cover_all_rules():
    assert len(RULES) > 300
    for rule in RULES:
        options = re.sub(r"\[.*?\]", "", rule.pattern)
        assert any(h in options for h in HINTS), rule


def test_no_python_in_the_plan(spark, folder):
    plan = scan.op8_license_scan(spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
