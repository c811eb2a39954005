"""Table, report and audit sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from casewatch.functions.numbers import finite_or_null
from casewatch.operators.dedupe import upsert
from casewatch.session import materialize
from casewatch.sources.files import path_exists, read_processed

BOM = "\ufeff"
PARTITIONS = ["enfermedad", "ANO"]
CASES_CODEC = "gzip"


def write_csv(df: DataFrame, path: str, by: str | None = None, compression: str | None = None) -> None:
    """CSV with header and byte-order mark in every part file; ``compression`` as Spark names it, at its fastest."""
    first = next(c for c in df.columns if c != by)
    writer = df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED")
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path, header=True, encoding="UTF-8", compression=compression)


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Parquet table, replaced or appended.

    A partitioned table is rebalanced first: adaptive execution then splits a
    partition that holds most rows over many tasks and merges small ones.
    """
    writer = df
    if partition_by:
        writer = df.hint("rebalance", *partition_by)
    out = writer.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)


def write_per_disease(df: DataFrame, path: str, disease: str = "enfermedad", compression: str | None = None) -> None:
    """One CSV folder per disease, named by its lower-case slug.

    Rows are not shuffled for it: diseases are few, and a task writes a file for each it holds.
    """
    slug = F.replace(F.lower(disease), F.lit(" "), F.lit("_"))
    known = df.filter(F.col(disease).isNotNull()).withColumn("slug", slug)
    write_csv(known, path, by="slug", compression=compression)


def write_outputs(
    clean: DataFrame, weekly: DataFrame, rejected: DataFrame, quality: DataFrame,
    folder: str, csv_copies: bool = True,
) -> None:
    """All ETL artefacts: Parquet and CSV of both tables, rejects, report.

    CSV files with a line per case are gzip files, as text they outweigh all else. ``weekly`` is read from ``weekly.parquet`` of the folder already.
    """
    write_table(clean, f"{folder}/clean.parquet", partition_by=PARTITIONS)
    flat = rejected.withColumn("reject_reason", F.array_join("reject_reason", "|")) if (
        "reject_reason" in rejected.columns
    ) else rejected
    write_csv(flat, f"{folder}/rejected.csv", None, CASES_CODEC)
    write_csv(quality, f"{folder}/quality.csv")
    quality.write.mode("overwrite").json(f"{folder}/quality.json")
    if csv_copies:
        stored = clean.sparkSession.read.parquet(f"{folder}/clean.parquet")
        write_csv(stored, f"{folder}/clean.csv", compression=CASES_CODEC)
        write_csv(weekly, f"{folder}/weekly.csv")
        write_per_disease(stored, f"{folder}/clean_by_disease", compression=CASES_CODEC)


def load_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Serving load: non-finite numbers become null; replace or append."""
    write_table(finite_or_null(df), path, mode)


def load_jdbc(
    df: DataFrame, url: str, table: str, mode: str = "overwrite", batch: int = 500,
    **properties: str,
) -> None:
    """Serving load into a database; replacing truncates and keeps the DDL."""
    finite_or_null(df).write.option("truncate", "true").option("batchsize", batch).jdbc(
        url, table, mode=mode, properties=properties
    )


def upsert_table(
    current: DataFrame | None, incoming: DataFrame, out_path: str, keys: list[str]
) -> DataFrame:
    """Write the merged table to a new path and read it back."""
    merged = incoming if current is None else upsert(current, incoming, keys)
    write_table(merged, out_path)
    return incoming.sparkSession.read.parquet(out_path)


def upsert_partitions(
    incoming: DataFrame, path: str, keys: list[str], by: tuple[str, ...] = ("disease", "month"), buckets: int = 64,
) -> DataFrame:
    """Merge rows into a table in place and read it back; only buckets with incoming rows are written.

    A row's bucket is a hash of the ``by`` columns of its key. Buckets no incoming row
    falls into keep their files; a bucket's files change when the job commits.
    """
    spark, bucket = incoming.sparkSession, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    tagged = incoming.withColumn("bucket", bucket)
    merged = tagged
    if path_exists(spark, path):
        # At most ``buckets`` numbers; they prune the folders that are read.
        touched = [r[0] for r in tagged.select("bucket").distinct().collect()]
        current = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        merged = upsert(current, tagged, keys)
    # Computed before any file is replaced.
    rows = materialize(merged.select(*tagged.columns))
    rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path).drop("bucket")


def audit_row(
    spark: SparkSession, source: str, clean_rows: int, aggregated_rows: int,
    prediction_rows: int = 0,
) -> DataFrame:
    return spark.range(1).select(
        F.current_timestamp().alias("loaded_at"), F.lit(source).alias("source"),
        F.lit(clean_rows).cast("long").alias("clean_rows"),
        F.lit(aggregated_rows).cast("long").alias("aggregated_rows"),
        F.lit(prediction_rows).cast("long").alias("prediction_rows"),
    )


def append_audit(row: DataFrame, path: str) -> None:
    write_table(row, path, mode="append")


def load_dashboard(spark: SparkSession, folder: str, serving: str, audit: str) -> DataFrame:
    """Load clean and weekly tables, append an audit row, return the counts."""
    counts = {}
    for name in ("clean", "weekly"):
        seen = Observation(name)
        load_table(read_processed(spark, folder, name).observe(seen, F.count(F.lit(1)).alias("rows")), f"{serving}/{name}")
        counts[name] = seen.get["rows"]
    row = audit_row(spark, "surveillance_etl", counts["clean"], counts["weekly"])
    append_audit(row, audit)
    return row.select("clean_rows", "aggregated_rows")
