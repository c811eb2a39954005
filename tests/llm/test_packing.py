import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from casewatch.llm import packing
from tokenizers import Tokenizer

TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return np.asarray([*TOKENS.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, docs):
    want = {i: ids(t) for i, t in docs}
    assert (rows.tier.isin(packing.TIERS)).all()
    for i, group in rows.sort_values("start").groupby("doc_id"):
        assert group.start.tolist() == [0, *group.length.cumsum()[:-1]]
        assert group.length.sum() == len(want[i]) == group.doc_tokens.iloc[0]
        for r in group.itertuples():
            assert zlib.crc32(want[i][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert set(rows.doc_id) == set(want)
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *group.length.cumsum()[:-1]]
        assert group.length.sum() + group.padding.iloc[0] == group.tier.iloc[0]


def test_whole_table(spark, folder, documents):
    rows = packing.op7_packing(spark, folder).toPandas()
    check(rows, zip(documents.doc_id, documents.text, strict=True))
    assert rows.groupby("sequence_id").padding.first().sum() <= 256 * 8


def test_odd_texts(spark):
    texts = [None, "", "  ", "a", "İΣΑΣ ẖ H̱ İ", "it's 12,5. x. ... ,a, \t b <|endoftext|> end.,", "Zoë, " * 9000, "é. É."]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, start string, tier int")
    check(packing.pack(docs).toPandas(), enumerate(texts))


def test_repeats_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema)).toPandas()
    assert rows.length.sum() == 3 * len(ids("a b"))
    assert rows.doc_id.isna().sum() >= 1


def test_step_groups_hold_equal_tokens():
    packer = packing.Packer((4, 8), 16, 0)
    for i in range(20):
        packer.add(i, bytes(4 * 8))
    rows = pd.DataFrame(packer.flush(True))
    assert rows.groupby(9)[2].sum().tolist() == [16] * 10


def test_short_documents_give_sequences_of_every_tier_and_equal_steps(spark):
    sizes = (8, 16, 32, 64)
    texts = [(i, "a " * (1 + int(62 * (i * 37 % 1000 / 1000) ** 3))) for i in range(4000)]  # mostly short
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = packing.pack(docs, tiers=sizes, step_tokens=256).toPandas()
    assert rows.length.sum() == sum(n.count("a") + 1 for _, n in texts)
    sequences = rows.groupby("sequence_id").agg(tier=("tier", "first"), group=("step_group", "first"), padding=("padding", "first"))
    assert (sequences.tier.value_counts().reindex(sizes) >= 100).all()
    assert (sequences.groupby("group").tier.nunique() == 1).all()
    for _, one in sequences.groupby("tier"):
        tokens = one.groupby("group").tier.sum().sort_index()
        assert (tokens.iloc[:-1] == 256).all() and tokens.iloc[-1] <= 256
    assert sequences.padding.sum() < 7 * sizes[0]


def test_every_sequence_starts_with_a_rest_of_its_tier():
    packer = packing.Packer((4, 8, 16), 64, 0)
    for i in range(600):
        packer.add(i, bytes(4 * (1 + i % 16)))
    rows = pd.DataFrame(packer.flush(False))
    longest = rows.groupby(5).agg(tier=(7, "first"), piece=(2, "max"))
    assert set(longest.tier) == {4, 8, 16}
    assert (longest.piece > longest.tier // 2).mean() > 0.95
    assert packer.waiting(16) < 16


def test_letters_skip_the_steps_that_leave_them_and_signs_are_learnt_once():
    words = packing.WordTokens(packing.tokenizer_path())
    given = {"letters": [], "other": []}

    def kept(kind, encode):
        return lambda texts, **how: given[kind].extend(texts[0]) or encode(texts, **how)

    words.encode, words.encode_letters = kept("other", words.encode), kept("letters", words.encode_letters)
    cores = ["house", "Éclair", "straße", "ǅon", "Ⱥb", "ŉa", "ªº", "µm", "x" * 300, "naïve", "İx", "σς", "e\u0301", "ab1", "a'b", "日本", "<|endoftext|>"]
    signs = ["", ".", ",", "$$$", "***", "'", "\"')", "_", "<|", "’", "…", "'s", "=\u0338"]
    texts = [core + sign for core in cores for sign in signs] + ["", "...", "'"]
    for text, found in zip(texts, words.texts(texts), strict=True):
        assert found == ids(text)[:-1].tobytes(), text
    assert not {w for w in given["other"] if w.startswith(("house", "éclair", "Éclair")) and w[-1] in "$*_|.,"}
    assert len(given["letters"]) == len(set(given["letters"])) and {"house", "éclair", "straße"} <= set(given["letters"])


def test_letters_and_signs_of_the_older_generation_are_not_tokenized_again():
    words = packing.WordTokens(packing.tokenizer_path(), limit=4)
    want = words.texts(["abc . def"])
    words.encode_letters = words.encode = None
    assert words.texts(["abc. Def"]) == want


def test_signs_digits_and_case_bring_no_new_words():
    words = packing.WordTokens(packing.tokenizer_path())
    given = []

    def kept(encode):
        return lambda texts, **how: given.extend(texts[0]) or encode(texts, **how)

    words.encode, words.encode_letters = kept(words.encode), kept(words.encode_letters)
    texts = ["house (house) house-house, ¿House? HOUSE2house", "“house” house’s 'house 2house2 house's", "éclair/Éclair=house"]
    for text, found in zip(texts, words.texts(texts), strict=True):
        assert found == ids(text)[:-1].tobytes(), text
    assert sorted(p for p in given if p.isalpha()) == ["house", "s", "éclair"]
    assert len(given) == len(set(given))


def test_plain_characters_in_words_of_all_kinds():
    chars = [*map(chr, range(1, 0x400)), *map(chr, range(0x1E00, 0x2100)), "日", "가", "ﬁ", "Ⱥ", "Å", "\ufeff", "😀"]
    texts = [a + c + b for c in chars for a in ("", "A", "'", "3", ".") for b in ("", "b", "'s", "\u0301", "!")]
    words = packing.WordTokens(packing.tokenizer_path())
    for text, found in zip(texts, words.texts(texts), strict=True):
        assert found == ids(text)[:-1].tobytes(), ascii(text)


def test_pieces_stay_few():
    words = packing.WordTokens(packing.tokenizer_path(), limit=6)
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(200)]
    for at in range(0, 200, 20):
        for n in (2, 20):
            part = texts[at:at + n]
            assert words.texts(part) == [ids(t)[:-1].tobytes() for t in part]
            assert len(words.now) <= 3 and len(words.old) <= 6


def test_a_text_longer_than_those_tokenized_together(spark):
    many = packing.TOGETHER // 2
    docs = spark.sql(f"SELECT col1 AS doc_id, repeat('a ', col2) AS text FROM VALUES (0L, 1), (1L, {many + 1}), (2L, 0), (3L, 2)").coalesce(1)
    rows = packing.pack(docs).toPandas()
    assert rows.groupby("doc_id").length.sum().tolist() == [2, many + 2, 1, 3]
    whole = np.append(np.full(many + 1, ids("a")[0], "<u4"), np.uint32(1))
    for r in rows[rows.doc_id == 1].itertuples():
        assert zlib.crc32(whole[r.start:r.start + r.length].tobytes()) == r.ids_crc32
