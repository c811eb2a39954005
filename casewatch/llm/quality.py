"""Quality rules: base measures of a text, and lines that too many documents of a host share.

One pass over the texts writes a narrow table: measures, and per document the
hash and word count of each distinct normalised line. All later steps read that
table, so texts are never shuffled for a verdict.

A line of ``least_chars`` characters or more is above the limit when more than
``limit`` distinct documents of its host hold it: a number that is the same for
hosts of all sizes. Exact copies count as one document: they are left to
deduplication and do not turn their own lines into boilerplate. A document is
depleted, and rejected, when it loses more than ``depleted`` of its words or has
fewer words left than a text needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm import common
from casewatch.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
LIMIT, LEAST_CHARS, DEPLETED = 5, 20, 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def normal_line(line: bytes) -> bytes:
    """A-Z in lower case, blanks as single spaces, none at the ends."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(line) - 2**63


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that the text holds twice or more."""
    if len(hashes) < window:
        return 0
    _, kind, count = np.unique(common.grams(hashes, window), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[kind] > 1)
    inside = np.zeros(len(hashes), bool)
    for i in range(window):
        inside[starts + i] = True
    return int(inside.sum())


def measure(text: str, words_of: common.WordHashes, least_chars: int = LEAST_CHARS) -> tuple:
    """Measures, and distinct normalised lines of ``least_chars`` characters with their words."""
    raw = common.encoded(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    held: dict[int, int] = {}
    for line in lines:
        parts = line.lower().split()
        normal = b" ".join(parts)
        if len(normal) < least_chars or (not normal.isascii() and len(normal.decode("utf-8", "replace")) < least_chars):
            continue
        key = line_hash(normal)
        held[key] = held.get(key, 0) + len(parts)
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words_of.of(words)), list(held), list(held.values()),
    )


def features(docs: DataFrame, doc_id: str, text: str, host: str, least_chars: int) -> DataFrame:
    """The narrow table, computed once."""
    schema = (
        "doc_id long, host string, k struct<id: long, h1: long, h2: long>, "
        + ", ".join(f"{m} long" for m in MEASURES) + ", lines array<bigint>, line_words array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = common.WordHashes()
        kinds = [*[pa.int64()] * len(MEASURES), *[pa.list_(pa.int64())] * 2]
        for batch in batches:
            found = zip(*[measure(t, words_of, least_chars) for t in batch["text"].to_pylist()], strict=True)
            made = [pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], [*batch.schema.names[:3], *MEASURES, "lines", "line_words"])
        words_of.clear()
        common.give_back()

    body = F.coalesce(F.col(text), F.lit(""))
    narrow = common.only(docs, doc_id=F.col(doc_id).cast("long"), host=F.col(host).cast("string"), k=common.text_key(F.col(doc_id), body), text=body)
    made = narrow.mapInArrow(run, schema)
    return materialize(made.withColumn("row", F.monotonically_increasing_id()))


def frequent_lines(table: DataFrame, limit: int) -> DataFrame:
    """Lines above the limit per host; a table, so that joins may split a line most documents of a host hold."""
    per_text = table.select("host", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"), F.explode("lines").alias("line")).distinct()
    counted = per_text.groupBy("host", "line").agg(F.count("*").alias("line_docs"))
    return materialize(counted.filter(F.col("line_docs") > limit).select("host", "line"))


def verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    limit: int = LIMIT, least_chars: int = LEAST_CHARS, depleted: float = DEPLETED,
) -> DataFrame:
    """One row per document: measures, words and lines to remove, verdict.

    A null text is empty and fails the base rule; null hosts are one host; rows that
    repeat a document count once and get a verdict each; an empty table gives no
    rows; a very long text is measured whole; other columns are not read.
    """
    table = features(docs, doc_id, text, host, least_chars)
    often = frequent_lines(table, limit)
    lines = table.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    lost = (
        lines.alias("l").join(often.alias("o"), F.expr("l.host <=> o.host AND l.x.lines = o.line"))
        .groupBy("row").agg(F.sum("x.line_words").alias("lost"), F.collect_list("line").alias("removed"))
    )
    joined = table.join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        "doc_id", "host", "k", *MEASURES, failed.alias("base_failed"), F.col("lost").alias("n_removed_words"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed_lines"), "removed",
        (~failed & (F.col("lost") <= depleted * F.col("n_words")) & (F.col("n_words") - F.col("lost") >= MIN_WORDS)).alias("kept"),
    )


@F.pandas_udf(T.StringType())
def without_lines(text: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines whose hash is listed."""
    out = []
    for t, gone in zip(text, removed, strict=True):
        if gone is not None and len(gone):
            drop = set(gone)
            t = "\n".join(x for x in t.split("\n") if not x.strip() or line_hash(normal_line(common.encoded(x))) not in drop)
        out.append(t)
    return pd.Series(out)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """Documents with a good verdict, without the lines above the limit; same columns."""
    decided = verdicts(docs, doc_id, text, host, **limits).filter("kept").select("k", "host", "removed").dropDuplicates(["k", "host"])
    rows = docs.select(F.struct("*").alias("r"), common.text_key(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("k"), F.col(host).cast("string").alias("host"))
    joined = rows.alias("a").join(decided.alias("b"), F.expr("a.k = b.k AND a.host <=> b.host")).select("r", "removed")
    whole = F.col(f"r.`{text}`")
    short = F.when(F.size("removed") > 0, without_lines(whole, "removed")).otherwise(whole)
    return joined.select(*[short.alias(c) if c == text else F.col(f"r.`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(common.read(spark, folder, "documents")).drop("host", "k", "removed")


SQL = {"op2_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM tri) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(o) GROUP BY r
), ls AS (
  SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), lw AS (
  SELECT r, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY r
), often AS (
  SELECT host, norm FROM lw WHERE length(norm) >= 20 GROUP BY host, norm HAVING count(DISTINCT text) > 5
), lost AS (
  SELECT r, sum(n) AS lost, count(DISTINCT lw.norm) AS lines FROM lw
  JOIN often o ON lw.host IS NOT DISTINCT FROM o.host AND lw.norm = o.norm GROUP BY r
), m AS (
  SELECT d.doc_id, len(w.ws) AS n_words,
    length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(lost.lost, 0) AS BIGINT) AS n_removed_words, coalesce(lost.lines, 0) AS n_removed_lines
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND n_removed_words <= 0.5 * n_words AND n_words - n_removed_words >= 50 AS kept FROM v
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_quality_rules": op2_quality_rules}
