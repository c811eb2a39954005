"""Hand-computed cases of the scalar functions."""

import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewatch import presets
from casewatch.functions import dates, epi, numbers, text
from casewatch.operators.priors import lag_month


def values(spark, rows, schema, *columns):
    """Evaluate columns over rows, in row order."""
    indexed = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(indexed, f"i int, {schema}")
    out = df.select("i", *[c.alias(f"v{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in out]


def test_normalize_text(spark):
    raw = [
        " nariño ", "sin dato", "n/a", "a \t b", None, "NO APLICA.", " SD ",
        "oﬁcina ½…", "Bogotá́ D.C.", "straße", "", "é",
    ]
    got = values(spark, raw, "x string", text.normalize_text("x"))
    assert got == [
        "NARINO", None, None, "A B", None, None, None, "OFICINA 1⁄2...", "BOGOTA D.C.",
        "STRASSE", None, "E",
    ]


def test_normalize_text_columns_agrees(spark):
    rows = [(" a  b ", "sd"), ("é", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    got = text.normalize_text_columns(df, ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [("A B", None), ("E", None)]


def test_normalize_name(spark):
    got = values(spark, [None, "  ", " san  andrés"], "x string", text.normalize_name("x"))
    assert got == ["SIN_DATO", "SIN_DATO", "SAN ANDRES"]


def test_titles(spark):
    got = values(
        spark, ["BOGOTA D.C.", "norte de santander"], "x string",
        text.title_words("x"), text.title_blank_separated("x"),
    )
    assert got == [
        ("Bogota D.C.", "Bogota D.c."), ("Norte De Santander", "Norte De Santander"),
    ]


def test_disease_names(spark):
    raw = ["chikunguya", " Malaria  vivax", "zika virus", None]
    got = values(spark, raw, "x string", text.normalize_disease("x"))
    assert got == ["Chikungunya", "Malaria", "Zika Virus", None]


def test_normalize_code(spark):
    raw = ["5", "5.0", "12345", "A", "SD", None, " 7 ", "00012"]
    got = values(
        spark, raw, "x string", text.normalize_code("x", 2), text.normalize_code("x", 5)
    )
    assert [g[0] for g in got] == ["05", "05", "12345", None, None, None, "07", "00012"]
    assert got[0][1] == "00005"


def test_to_int(spark):
    raw = ["2.5", "3.5", "1d", "abc", " 12 ", "inf", "1e2", "-4", None, "99999999999"]
    got = values(spark, raw, "x string", numbers.to_int("x"))
    assert got == [2, 4, None, None, 12, None, 100, -4, None, None]


def test_rounding(spark):
    got = values(
        spark, [1.015, 0.125, 2.5], "x double",
        numbers.round_even("x", 2), numbers.round_up("x", 2),
    )
    assert [g[0] for g in got] == [1.01, 0.12, 2.5]
    assert got[1][1] == 0.13


def test_exact_mean(spark):
    df = spark.createDataFrame([(0.12,), (0.13,), (None,)], "x double")
    row = df.select(
        numbers.exact_mean("x").alias("even"), numbers.exact_mean("x", half_up=True).alias("up")
    ).head()
    assert (row["even"], row["up"]) == (0.12, 0.13)


def test_finite_or_null(spark):
    df = spark.createDataFrame(
        [(1.5, "a"), (float("nan"), "b"), (float("inf"), "c"), (None, "d")], "x double, y string"
    )
    assert [r["x"] for r in numbers.finite_or_null(df).orderBy("y").collect()] == [
        1.5, None, None, None
    ]


def test_half_up_percent(spark):
    got = values(
        spark, [(1, 8), (0, 0)], "a long, b long",
        numbers.half_up_percent(F.col("a"), F.col("b")),
    )
    assert got == [13, 0]


def test_iso_week_month(spark):
    weeks = [(2024, 1), (2025, 1), (2024, 53), (2020, 53), (2024, 0), (None, 3), (99999, 1)]
    got = values(spark, weeks, "y int, w int", dates.iso_week_month("y", "w"))
    assert got == [1, 12, None, 12, None, None, None]


def test_iso_week_against_python(spark):
    from datetime import date

    weeks = [(y, w) for y in range(2000, 2032) for w in range(0, 55)]
    got = values(spark, weeks, "y int, w int", dates.iso_week_monday("y", "w"))

    def expected(y, w):
        try:
            return date.fromisocalendar(y, w, 1)
        except ValueError:
            return None

    assert got == [expected(y, w) for y, w in weeks]


def test_calendar_week_against_python(spark):
    weeks = [(y, w) for y in range(2000, 2032) for w in range(1, 53)]
    got = values(spark, weeks, "y int, w int", dates.calendar_week_monday("y", "w"))
    assert got == [
        datetime.strptime(f"{y}-W{w:02d}-1", "%Y-W%W-%w").date() for y, w in weeks
    ]


def test_parse_date(spark):
    raw = [
        "2024-03-05", "05/03/2024", "25/03/2024", "x", "2024-03-05T10:20:30.5", "5/3/24",
        "20240305", "5 Mar 2024", None, "31/02/2024", " 2024/03/05 01:02 ",
    ]
    got = values(spark, raw, "x string", dates.parse_date("x"))
    assert got == [
        datetime(2024, 3, 5), datetime(2024, 5, 3), datetime(2024, 3, 25), None,
        datetime(2024, 3, 5, 10, 20, 30, 500000), datetime(2024, 5, 3), datetime(2024, 3, 5),
        datetime(2024, 3, 5), None, None, datetime(2024, 3, 5, 1, 2),
    ]


def test_delay_days(spark):
    onset = datetime(2024, 1, 10)
    pairs = [
        (datetime(2024, 1, 9, 12), onset), (datetime(2025, 1, 9), onset),
        (datetime(2025, 1, 10), onset), (datetime(2024, 1, 11, 6), datetime(2024, 1, 10, 12)),
        (None, onset),
    ]
    got = values(
        spark, pairs, "a timestamp_ntz, b timestamp_ntz", dates.delay_days("a", "b")
    )
    assert got == [None, 365, None, 0, None]


def test_age(spark):
    ages = [(6, 2), (10, 3), (5, None), (121, 1), (-1, 1), (24, 4), (7, 9)]
    got = values(spark, ages, "a int, u int", epi.age_in_years("a", "u"))
    assert got == [0.5, 0.03, 5.0, None, None, 0.0, 7.0]


def test_age_group(spark):
    ages = [0.0, 4.0, 4.5, 59.0, 60.0, None]
    got = values(spark, ages, "a double", epi.age_group("a"))
    assert got == ["0-4", "0-4", "5-14", "45-59", "60+", "Sin dato"]


def test_labels(spark):
    got = values(spark, [50, 51, 200, 201], "n long", epi.risk_label("n"))
    assert got == ["bajo", "medio", "medio", "alto"]
    got = values(spark, [4.99, 5.0, 25.0, 75.0], "n double", epi.outbreak_level("n"))
    assert got == ["Sin brote relevante", "Brote bajo", "Brote medio", "Brote alto"]


def test_sex_and_codes(spark):
    got = values(spark, ["MUJER", "M", "X", None], "s string", epi.recode_sex("s"))
    assert got == ["F", "M", None, None]
    got = values(spark, [1, 9, None], "c int", epi.decode("c", presets.CASE_TYPES))
    assert got == ["Sospechoso", "Sin dato", "Sin dato"]
    got = values(spark, ["C", "Z", None], "c string", epi.decode_insurance("c"))
    assert got == ["Contributivo", "Z", "Sin dato"]


def test_confirmed(spark):
    rows = [(None, "x", 1), (0, "Caso confirmado", 1), (0, None, 3), (1, None, None), (0, "no", 2)]
    got = values(
        spark, rows, "f int, s string, t int", epi.confirmed_flag("f", "s", "t")
    )
    assert got == [0, 1, 1, 1, 0]


def test_climate_score(spark):
    rows = [(27.0, 8000.0, 90.0, 1.0, 1), (14.0, 1000.0, 75.0, 0.2, 0)]
    got = values(
        spark, rows, "t double, p double, h double, s double, r int",
        epi.climate_risk_score("t", "p", "h", "s", "r"),
    )
    assert got == [0.9144, 0.2633]


def test_targets(spark):
    for method in ("sqrt", "log1p", "none"):
        got = values(
            spark, [0.0, 9.0], "y double",
            epi.inverse_target(epi.transform_target("y", method), method),
        )
        assert got == pytest.approx([0.0, 9.0])


def test_lag_month(spark):
    months = [1, 2, 12]
    compat = values(spark, months, "m int", *[lag_month(F.col("m"), k, True) for k in range(1, 7)])
    assert compat == [(12,) * 6, (1, 12, 12, 12, 12, 12), (11, 10, 9, 8, 7, 6)]
    wrapped = values(spark, months, "m int", *[lag_month(F.col("m"), k, False) for k in range(1, 7)])
    assert wrapped[0] == (12, 11, 10, 9, 8, 7)


def test_folds_all_compatibility_letters(spark):
    raw = ["\U0001d400\U0001d41a", "\ufefb", "\u3392", "\U0001e944\U00011099", "각"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in raw]
    assert values(spark, raw, "x string", text.fold_accents("x")) == want


def test_every_character_folds_alike_in_short_and_full_tables(spark):
    """Each alone (short table where it is Latin), and beside one that needs the full tables."""
    chars = [chr(p) for p in [*range(0x80, 0x500), *range(0x1e00, 0x2200)]]
    want = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in chars]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in chars], "x string").select(text.fold_accents("x")).collect()] == want
    mixed = ["ñandú " + c + " \u0439" for c in chars]
    full = ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in mixed]
    got = spark.createDataFrame([(x,) for x in mixed], "x string").select(text.fold_accents("x")).collect()
    assert [r[0] for r in got] == full


def test_header_names():
    assert text.normalize_header("") == text.normalize_header(" - ") == ""

    assert text.normalize_header("﻿ Fecha de notificación ") == "FECHA_DE_NOTIFICACION"
    assert text.normalize_header("AÑO") == "ANO"


def test_plain_values_take_the_short_way(spark):
    """Values as they should be are told first; odd ones next to them are read as before."""
    df = spark.createDataFrame([("x",)], "x string")
    plan = df.select(dates.parse_date("x"), numbers.to_int("x"), text.code_digits("x"), text.upper_plain("x"))._jdf.queryExecution().analyzed().toString()
    for told in (dates._PLAIN, r"^[0-9]+\z", "[^ -~]", "cast(cast(x"):
        assert told in plan
    odd = ["2024-01-05\n", "\x002024-01-05", "2024-13-05", "2024-02-30", "2024-01-05T24:00:00", "2024-01-05T23:59:60", "2024-01-05 10:20:30.1234567",
           "2024-01-05T10:20:30.123456", "0000-01-05"]
    got = values(spark, odd, "x string", dates.parse_date("x").cast("string"))
    assert got == ["2024-01-05 00:00:00", None, "2024-05-13 00:00:00", None, None, "2024-01-06 00:00:00", None, "2024-01-05 10:20:30.123456", "0000-01-05 00:00:00"]
    got = values(spark, ["-0", "+5", "007", "12\n", "\x0012", "1.5", "2147483647", "2147483648", "12L"], "x string", numbers.to_int("x"))
    assert got == [0, 5, 7, 12, None, 2, 2147483647, None, None]
    assert values(spark, ["12\n", "05", "1 2", "٣", ""], "x string", text.code_digits("x")) == ["12", "05", "12", "", ""]
    assert values(spark, ["a b", "a  b", " a", "a ", "a\tb", "a\x7f", "á b", "", None], "x string", text.upper_plain("x")) == [
        "A B", "A B", "A", "A", "A B", "A\x7f", "A B", "", None]
