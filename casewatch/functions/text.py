"""Text, name and code normalisation as JVM-side column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from casewatch import presets

# Whitespace as Python's ``str.strip`` sees it; Java's ``\s`` is ASCII only.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The outer range is tested first and settles nearly every character.
SPACE = (
    r"[\x00-\x20\x85-\u3000&&"
    r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
# Whitespace that is not already one plain blank.
UNEVEN_SPACE = f"{SPACE}{{2,}}|(?! ){SPACE}"
SURROGATES = range(0xD800, 0xE000)  # no characters


def _fold_char(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char)
    return "".join(c for c in decomposed if not unicodedata.combining(c))


@cache
def fold_tables() -> tuple[str, str, dict[str, str]]:
    """One-to-one fold (source and target strings) and the one-to-many folds.

    All code points whose compatibility decomposition differs, built once.
    """
    source, target, longer = [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        if point in SURROGATES:
            continue
        char = chr(point)
        if unicodedata.combining(char):
            continue
        folded = _fold_char(char)
        if len(folded) == 1 and folded != char:
            source.append(char)
            target.append(folded)
        elif len(folded) != 1:
            longer[char] = folded
    return "".join(source), "".join(target), longer


#: Signs above the Latin letters that are common in running text.
COMMON_SIGNS = "\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2020\u2021\u2022\u20ac"
LATIN_END = 0x250


@cache
def latin_tables() -> tuple[str, str, str]:
    """One-to-one folds of Latin letters (source and target), and the letters and signs that stay."""
    source, target, longer = fold_tables()
    pairs = [(a, b) for a, b in zip(source, target, strict=True) if ord(a) < LATIN_END]
    known = {a for a, _ in pairs} | set(longer)
    stay = [chr(p) for p in range(0x80, LATIN_END) if chr(p) not in known]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), "".join(stay) + COMMON_SIGNS


def _ranges(points: Iterable[int]) -> str:
    """Body of a regex class, neighbours joined to ranges."""
    spans: list[list[int]] = []
    for point in sorted(points):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


@cache
def combining_class() -> str:
    """Regex class of the characters with a non-zero combining class."""
    points = [p for p in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(p))]
    return f"[\\p{{M}}&&[{_ranges(points)}]]"


@cache
def longer_class() -> str:
    """Regex class of the characters that unfold to several."""
    return f"[{_ranges(ord(c) for c in fold_tables()[2])}]"


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold_accents(value: str | Column) -> Column:
    """NFKD-fold and drop combining marks, without a Python UDF.

    Rows of plain ASCII, recognised by their byte length, skip the work. Rows of
    Latin letters that fold one to one take a short table. For all others the
    characters that unfold to several (``\ufb01``, ``\u00bd``) are replaced
    one by one where a row holds any, and the rest goes by the full tables.
    """
    text = col(value)
    short_source, short_target, stay = latin_tables()
    short = F.translate(text, short_source, short_target)
    settled = ~F.translate(short, stay, "").rlike("[^\\x00-\\x7f]")
    source, target, longer = fold_tables()
    pairs = "\x02".join(f"{char}\x01{folded}" for char, folded in longer.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({longer_class()})"), 1))
    unfolded = F.aggregate(
        found, text, lambda acc, c: F.replace(acc, c, F.element_at(table, c))
    )
    folded = F.regexp_replace(F.translate(unfolded, source, target), combining_class(), "")
    return F.when(F.octet_length(text) == F.length(text), text).when(settled, short).otherwise(folded)


def strip(value: str | Column) -> Column:
    return F.trim(col(value), F.lit(BLANKS))


def squeeze(value: str | Column) -> Column:
    """Collapse whitespace runs to one blank and trim."""
    return F.trim(F.regexp_replace(col(value), UNEVEN_SPACE, " "))


def missing_to_null(
    value: str | Column, tokens: list[str] = presets.MISSING_TOKENS
) -> Column:
    """Null for a missing token; the text must be in upper case."""
    text = col(value)
    return F.when(~text.isin(tokens), text)


def upper_plain(value: str | Column) -> Column:
    """Upper-case, accent-free, single-spaced text.

    Printable ASCII with single blanks inside only is told by one pass and needs no other.
    """
    text = col(value)
    uneven = text.rlike("[^ -~]") | text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    return F.upper(F.when(~uneven, text).otherwise(squeeze(fold_accents(text))))


def normalize_text(value: str | Column) -> Column:
    """Upper-case, accent-free, single-spaced text; missing tokens become null.

    Checking the tokens once, at the end, also finds every spelling that was
    missing at the start.
    """
    return missing_to_null(upper_plain(value))


def normalize_text_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``normalize_text`` on many columns, in place.

    Two projections: the second reads each text twice, and the optimizer keeps
    the first one computed once instead of repeating it.
    """
    columns = list(columns)
    plain = df.withColumns({c: upper_plain(c) for c in columns})
    return plain.withColumns({c: missing_to_null(c) for c in columns})


def normalize_name(value: str | Column, default: str = presets.NO_DATA) -> Column:
    """Place-name key: as text, but null and blank become a sentinel."""
    return F.coalesce(F.nullif(upper_plain(value), F.lit("")), F.lit(default))


def normalize_key(value: str | Column) -> Column:
    return F.upper(strip(value))


def title_words(value: str | Column) -> Column:
    """Capitalise after any character that is not a letter or digit.

    ``initcap`` restarts only after whitespace, so ``BOGOTA D.C.`` would become
    ``Bogota D.c.``.
    """
    runs = F.regexp_extract_all(
        F.lower(col(value)), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1
    )
    return F.array_join(F.transform(runs, F.initcap), "")


def title_blank_separated(value: str | Column) -> Column:
    """Capitalise blank-separated words and join them with single blanks."""
    return F.initcap(squeeze(F.lower(F.coalesce(col(value), F.lit("")))))


def normalize_disease(
    value: str | Column, names: dict[str, str] = presets.DISEASE_NAMES
) -> Column:
    """Known disease names and synonyms, else the trimmed title-cased value.

    A null is ``<NA>`` in the reference's text form; here it stays null so the
    row filter drops it.
    """
    known = lookup(normalize_name(value), names)
    return F.when(col(value).isNotNull(), F.coalesce(known, title_words(strip(value))))


def lookup(key: Column, table: dict) -> Column:
    """Value of a short literal code list; unmapped keys are null.

    A map evaluates ``key`` once, a chain of comparisons once per code.
    """
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(pairs, key)


def code_digits(value: str | Column) -> Column:
    """Digits of a code without a trailing ``.0``; no missing token has any."""
    text = col(value)
    whole = F.regexp_replace(F.trim(squeeze(text)), r"\.0$", "")
    return F.when(text.rlike(r"^[0-9]+\z"), text).otherwise(F.regexp_replace(whole, "[^0-9]", ""))


def pad_code(digits: str | Column, width: int) -> Column:
    """Zero-padded to ``width`` and never truncated; empty becomes null."""
    text = col(digits)
    size = F.greatest(F.length(text), F.lit(width))
    return F.when(text != "", F.lpad(text, size, F.lit("0")))


def normalize_code(value: str | Column, width: int) -> Column:
    return pad_code(code_digits(value), width)


def same_text(value: str | Column, wanted: str) -> Column:
    """Case-insensitive equality with a constant."""
    return F.upper(col(value)) == F.lit(wanted.upper())


def normalize_header(name: str) -> str:
    """Key by which a header finds its canonical column (names only, on the driver).

    Plain capital letters and digits in runs, one underscore between two runs.
    """
    plain = "".join(map(_fold_char, name)).upper()
    return "_".join(re.findall("[A-Z0-9]+", plain))
