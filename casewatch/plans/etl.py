"""End-to-end ETL: read, align, clean, dedupe, split, aggregate, report, load."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.operators.aggregates import weekly_aggregate
from casewatch.operators.align import align_source, source_defaults, union_filled, union_sources
from casewatch.operators.clean import clean_cases, flag_rejected, with_derived
from casewatch.operators.dedupe import dedupe_cases
from casewatch.operators.quality import quality_report
from casewatch.session import drop_scratch, materialize, scratch_count, wide_job
from casewatch.sources import files, release, sinks

ORDER = "row_ordinal"
COPIES = "_copies"


@dataclass(frozen=True)
class Source:
    """One raw source and what is known about it before reading."""

    disease: str
    event_code: int
    year: int
    source: str
    path: str


@dataclass(frozen=True)
class EtlResult:
    clean: DataFrame
    rejected: DataFrame
    weekly: DataFrame
    quality: DataFrame


def read_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Clean rows of all sources that exist, with their order for deduplication.

    Raw files are read once, into a staged table of the clean rows.
    """
    frames = []
    for ordinal, source in enumerate(sources):
        if not files.path_exists(spark, source.path):
            continue
        raw = files.read_csv(spark, source.path)
        filename = source.path.rstrip("/").rsplit("/", 1)[-1]
        aligned = align_source(
            raw, source.disease, source.event_code, source.year, source.source,
            filename, keep=[files.ROW_ORDER], fill=False,
        )
        # One number for source and row: a fixed-width value that aggregates
        # can compare without sorting.
        first = F.lit(Decimal(ordinal * 10**35)).cast("decimal(38,0)")
        place = (first + F.col(files.ROW_ORDER)).cast("decimal(38,0)")
        defaults = source_defaults(source.disease, source.event_code, source.year)
        frames.append((aligned.withColumn(ORDER, place).drop(files.ROW_ORDER), defaults))
    if not frames:
        return union_sources([])
    # Cleaning is row by row, so the pass that stages the rows of all sources does it. Derived
    # columns tell nothing that the others do not, so they are not stored.
    return with_derived(union_filled(frames, lambda df: clean_cases(df).drop(*presets.DERIVED_COLUMNS)))


def stage_cases(cases: DataFrame, path: str, order_by: list[str] | None = None) -> DataFrame:
    """Deduplicate, flag and write once; later steps read the written table.

    The one heavy shuffle of the job is the deduplication. Everything after
    reads Parquet with the columns and partitions it needs, and does not
    depend on executors keeping cached blocks. Derived columns are added behind it.
    ``order_by`` is the place of a row in its source, which no other row has.
    """
    deduped = dedupe_cases(cases.drop(*presets.DERIVED_COLUMNS), order_by=order_by, copies=COPIES, unique=bool(order_by))
    flagged = flag_rejected(with_derived(deduped))
    flagged.write.mode("overwrite").partitionBy("is_rejected").parquet(path)
    # Partition values come back as text.
    return cases.sparkSession.read.parquet(path).withColumn(
        "is_rejected", F.col("is_rejected").cast("boolean")
    )


def derive(staged: DataFrame, weekly_path: str) -> EtlResult:
    """Clean and rejected rows, weekly aggregate and report of staged cases.

    The weekly table is written here and the report computed once, so that no later
    reader of either goes back to the cases.
    """
    columns = [
        *presets.CANONICAL_COLUMNS, *presets.LINEAGE_COLUMNS, *presets.DERIVED_COLUMNS
    ]
    valid = staged.filter(~F.col("is_rejected"))
    found = weekly_aggregate(valid, order_by=ORDER if ORDER in staged.columns else None)
    sinks.write_table(found, weekly_path)
    weekly = staged.sparkSession.read.parquet(weekly_path)
    return EtlResult(
        clean=valid.select(*columns),
        rejected=staged.filter("is_rejected").select(*columns, "reject_reason"),
        weekly=weekly,
        quality=materialize(quality_report(staged, columns, copies=COPIES, weekly=weekly)),
    )


def write_artefacts(spark: SparkSession, sources: list[Source], folder: str, csv_copies: bool = False) -> EtlResult:
    """From raw files to the artefacts in ``folder``.

    Shuffle files and staged tables go as soon as nothing reads them, so that the disk
    holds the artefacts and one step's files, not those of all steps.
    """
    with wide_job(spark):
        held = scratch_count()
        # Deduplication reads the staged rows twice: narrow for the keys, whole for those that stay.
        cases = read_sources(spark, sources)
        staged = stage_cases(cases, f"{folder}/stage.parquet", order_by=[ORDER])
        drop_scratch(spark, held)
        result = derive(staged, f"{folder}/weekly.parquet")
        sinks.write_outputs(
            result.clean, result.weekly, result.rejected, result.quality, folder, csv_copies
        )
    return result


def run_etl(
    spark: SparkSession, sources: list[Source], folder: str, csv_copies: bool = False
) -> EtlResult:
    """Whole job from raw files to the written artefacts and the serving load, in place."""
    result = write_artefacts(spark, sources, folder, csv_copies)
    sinks.load_dashboard(spark, folder, f"{folder}/serving", f"{folder}/audit")
    return result


def publish(spark: SparkSession, sources: list[Source], root: str, csv_copies: bool = False) -> EtlResult:
    """The job into a new release of ``root``; readers see all of its artefacts or none.

    Readers of ``root`` follow its pointer, which moves once the release is whole and
    listed. A job that ends early leaves the release before it in place.
    """
    folder = release.begin(root)
    result = write_artefacts(spark, sources, folder, csv_copies)
    release.commit(spark, root, folder)
    sinks.load_dashboard(spark, root, f"{root}/serving", f"{root}/audit")
    return result
