"""From raw documents to packed training sequences, stage by stage.

Every stage is written as Parquet and read again as the documents of the next one.
All but the last return the columns of documents, whatever they are; further columns of
a row stay with it. Every stage takes empty tables, to which it adds no rows, and texts of
any length, which are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import exact, forest, mixing, packing, quality
from casewatch.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a good verdict; lines that too many documents of a host share are gone.

    A null text is empty and goes; null hosts are one host; rows that repeat a document have
    its verdict each.
    """
    return recounted(quality.clean(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier.

    A null identifier is the smallest, a null text equals an empty one; of rows that repeat
    both, one stays.
    """
    return exact.deduplicate(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the largest identifier.

    Null and empty texts are one class; of rows that repeat identifier and text, one stays.
    """
    return forest.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null texts have no words, null sources come last."""
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and where they lie in training sequences; a null text is its end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]
#: Pivotal draws and minimum hashes have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
