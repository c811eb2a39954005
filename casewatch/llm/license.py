"""License scan: ordered signature rules with a keyword gate and containment suppression.

A text becomes canonical: A-Z in lower case, words between single spaces. Rules are
tried only on texts that hold a hint word, and each rule only where its own literals
stand. Detections are word intervals. One that lies inside another of the same or a
higher priority goes; of equal intervals the higher priority, then the earlier rule,
stays. Texts are read once; all else works on a narrow table of detections.

Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewatch.llm import common
from casewatch.llm.signatures import CONFIDENCE, EXACT, HINTS, NAME, RULES, Rule
from casewatch.session import materialize

#: Phrases every scan counts, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """Words between single spaces, one space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), NO_WORD, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def bounded(pattern: str) -> str:
    """Whole words only; the spaces around a match belong to no match."""
    return f"(?<= )(?:{pattern})(?= )"


def any_of(text: Column, literals: list[str]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(text, F.lit(literal))
    return found


def base_columns(canon: Column, n_words: Column) -> dict[str, Column]:
    """Places of the base phrases: how many, the smallest and the largest start."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        pieces = F.when(F.contains(canon, F.lit(f" {phrase} ")), F.split(canon, bounded(phrase), -1))
        counts.append(F.coalesce(F.size(pieces) - 1, F.lit(0)))
        firsts.append(spaces(F.element_at(pieces, 1)) - 1)
        lasts.append(n_words - (spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split()))
        labels.append(F.when(pieces.isNotNull(), F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"), "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"), "base": F.array_compact(F.array(*labels)),
    }


def rule_literals(rules: list[Rule]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(bounded(r.pattern)).alias("pattern"),
            (F.array(*map(F.lit, r.gate)) if r.gate else F.array().cast("array<string>")).alias("gate"), F.lit(r.priority).alias("priority"))
        for i, r in enumerate(rules)
    ])


def detections(canon: Column, rules: list[Rule]) -> Column:
    """Array of (rule, label, priority, start, end) with word numbers, end exclusive."""

    def places(rule: Column) -> Column:
        # Text between matches and the matches alternate; their spaces count the words.
        pairs = F.arrays_zip(F.split(canon, rule["pattern"], -1).alias("piece"), F.regexp_extract_all(canon, rule["pattern"], F.lit(0)).alias("hit"))
        empty = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + spaces(pair["piece"])
            inner = spaces(pair["hit"])
            one = F.struct(start.alias("start"), (start + inner + 1).alias("end"))
            return F.when(pair["hit"].isNull(), acc).otherwise(
                F.struct((start + inner).alias("at"), F.concat(acc["found"], F.array(one)).alias("found")))

        found = F.aggregate(pairs, empty, step)["found"]
        return F.transform(found, lambda p: F.struct(
            rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), p["start"].alias("start"), p["end"].alias("end")))

    tried = F.filter(rule_literals(rules), lambda r: F.forall(r["gate"], lambda g: F.contains(canon, g)))
    hit = F.filter(tried, lambda r: F.regexp_like(canon, r["pattern"]))
    return F.flatten(F.transform(hit, places))


def standing(found: DataFrame, *key: str) -> DataFrame:
    """Detections that no other one of the same or a higher priority contains.

    In the order of starts, longest first, everything that contains an interval comes
    before it, so one running maximum of ends per priority decides.
    """
    order = W.partitionBy(*key).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in range(NAME, EXACT + 1)]
    seen = found.withColumn("reach", F.element_at(F.array(*reach), F.col("priority")))
    return seen.filter("reach IS NULL OR reach < end").drop("reach")


def scan_table(docs: DataFrame, doc_id: str, text: str, rules: list[Rule]) -> DataFrame:
    """Per document: word count, base places and all detections; computed once."""
    lower = common.only(docs, doc_id=F.col(doc_id).cast("long"), canon=canonical(F.coalesce(F.col(text), F.lit(""))))
    counted = lower.withColumn("n_words", F.when(F.col("canon") == "  ", 0).otherwise(spaces(F.col("canon")) - 1).cast("long"))
    canon = F.col("canon")
    return materialize(counted.select(
        "doc_id", "n_words", *[c.alias(n) for n, c in base_columns(canon, F.col("n_words")).items()],
        F.when(any_of(canon, HINTS), detections(canon, rules)).alias("found"), F.monotonically_increasing_id().alias("row"),
    ))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per detection that stands: document, rule, label, priority and word interval."""
    return standing_spans(scan_table(docs, doc_id, text, rules))


def standing_spans(table: DataFrame) -> DataFrame:
    return standing(table.select("row", "doc_id", F.inline("found")), "row")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: base places, labels of base and rules, score.

    The score is the confidence of the most specific detection, 0 without one. A null
    text is empty and has no words, places or labels; rows that repeat a document are
    scanned each; an empty table gives no rows; other columns are not read.
    """
    table = scan_table(docs, doc_id, text, rules)
    per_row = standing_spans(table).groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("priority").alias("best"), F.count("*").alias("n_found"))
    both = F.array_sort(F.array_union("base", F.coalesce("labels", F.array().cast("array<string>"))))
    sure = F.coalesce(*[F.when(F.col("best") == p, F.lit(c)) for p, c in CONFIDENCE.items()])
    least = F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[NAME])).otherwise(F.lit(0.0))
    return table.join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.greatest(F.coalesce(sure, F.lit(0.0)), least).alias("score"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(common.read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_license_scan": op8_license_scan}
