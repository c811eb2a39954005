from collections import Counter

from casewatch.llm import common, quality
from compare import connect, differences


def brute(text):
    text = text or ""
    words = "".join(" " if c in quality.BLANKS else c for c in text).split(" ")
    words = [w for w in words if w]
    runs = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + o for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if any(c not in quality.BLANKS for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_match_brute_force(documents):
    hashes = common.WordHashes()
    odd = ["", " ", "a", "a b", "a a a", "a a a a", "x y\x1cz\x85", "L\nL\n\n L\nl", "#&<|>*$%"]
    for text in [*documents.text, *odd]:
        assert quality.measure(text, hashes)[:5] == brute(text), text[:80]


def test_query_matches_sql(spark, folder):
    got = quality.op2_quality_rules(spark, folder).toPandas()
    assert differences(got, connect(folder).sql(quality.SQL["op2_quality_rules"]).df()) == []
    assert got.kept.any()


def corpus(spark):
    own = [" ".join(f"w{i}_{j}" for j in range(60)) for i in range(30)]
    rows = [(i, f"Shared  LINE here\n{t}", "h", "x") for i, t in enumerate(own)]
    rows += [(100, "shared line here\n" * 19 + own[0], "h", "x"), (101, own[1] + "\nshared line here", None, "x")]
    rows += [(102, None, "h", "x"), (103, "", "h", None), (None, own[2], "h", "x"), (5, rows[5][1], "h", "x")]
    rows += [(200 + i, f"{own[3]} one text copied", "g", "x") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string"), rows


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    docs, rows = corpus(spark)
    got = quality.verdicts(docs, least_chars=16).toPandas()
    assert len(got) == len(rows)
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by.n_removed_words[0] == 3 and by.kept[0]
    assert by.n_removed_words[100] == 57 and by.n_removed_lines[100] == 1 and by.kept[100]
    strict = quality.verdicts(docs, least_chars=16, depleted=0.4).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert not strict.kept[100] and strict.kept[0]
    assert by.n_removed_words[101] == 0  # another host
    assert not by.kept[102] and by.n_words[102] == 0 and by.base_failed[103]
    assert by.kept[200] and by.n_removed_words[200] == 0  # copies are one document
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_clean_keeps_columns_and_removes_lines(spark):
    docs, _ = corpus(spark)
    got = quality.clean(docs, least_chars=16)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert 102 not in rows and not rows[0].text.lower().startswith("shared")
    assert "shared line" in rows[101].text and None in rows
    assert sum(r.doc_id == 5 for r in got.collect()) == 2


def test_the_limit_is_a_number_and_short_lines_stay(spark):
    own = [" ".join(f"w{i}_{j}" for j in range(50)) for i in range(400)]
    line = "a footer of six words here"
    rows = [(i, f"{t}\n{line}", "small") for i, t in enumerate(own[:6])] + [(100 + i, f"{t}\n{line}\nshort one" if i < 6 else t, "large") for i, t in enumerate(own)]
    rows += [(900 + i, f"{t}\n{line}", "five") for i, t in enumerate(own[:5])]
    got = quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert (got.n_removed_words[[*range(6), *range(100, 106)]] == 6).all()  # six documents are above five, in a host of any size
    assert (got.n_removed_words[range(900, 905)] == 0).all()
    assert got.kept.all()  # 50 words are left
    less = [(i, t.rsplit(" ", 1)[0] + "\n" + line, s) for i, t, s in ((i, t.split("\n")[0], s) for i, t, s in rows[:6])]
    assert not quality.verdicts(spark.createDataFrame(less, "doc_id long, text string, source string")).toPandas().kept.any()


def test_other_columns_may_clash_and_long_texts(spark):
    long = "a word " * 200_000
    docs = spark.createDataFrame([(1, long, "h", 1, 2), (2, "x\n" * 100_000, "h", 1, 2)], "doc_id long, text string, source string, host int, lines int")
    got = quality.verdicts(docs).toPandas().set_index("doc_id")
    assert got.n_words[1] == 400_000 and got.n_dup_lines[2] == 99_999
