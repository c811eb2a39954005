"""Source catalogue, raw-file checks and the ingest manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewatch import presets
from casewatch.sources.heads import file_heads


def source_catalog(spark: SparkSession, year: int | None = None) -> DataFrame:
    """Configured sources, optionally of one year."""
    kinds = "disease string, slug string, year int, event_code int, source string, filename string"
    catalog = spark.createDataFrame(presets.SOURCES, kinds)
    return catalog if year is None else catalog.filter(F.col("year") == year)


def looks_like_html(head: Column) -> Column:
    """The first bytes of a text hold an HTML page's opening tag."""
    text = F.lower(head)
    return text.contains("<html") | text.contains("<!doctype html")


def is_valid_file(filename: Column, content: Column, size: Column | None = None) -> Column:
    """Signature check of a raw file's bytes.

    Only the leading bytes are looked at: that is what a signature is. ``content``
    may be these alone when ``size`` gives the length of the file.
    """
    size = F.octet_length(content) if size is None else size
    name = F.lower(filename)
    head = F.substring(content, 1, presets.SIGNATURE_BYTES)
    html = looks_like_html(F.decode(F.encode(F.decode(head, "ISO-8859-1"), "UTF-8"), "UTF-8"))
    return (
        F.when(size < presets.MIN_FILE_BYTES, False)
        .when(name.endswith(".xlsx"), F.substring(content, 1, 2) == F.encode(F.lit("PK"), "UTF-8"))
        .when(name.endswith(".csv"), ~html)
        .otherwise(True)
    )


def raw_files(spark: SparkSession, folder: str, name: Column | None = None) -> DataFrame:
    """Name, path, size and signature check of the files in a folder, of any size.

    Of each file only the bytes of a signature are read. ``name`` overrides the file's
    name (an expression of ``path``).
    """
    name = F.element_at(F.split("path", "/"), -1) if name is None else name
    return file_heads(spark, folder, presets.SIGNATURE_BYTES).select(
        name.alias("filename"), "path", "size_bytes", is_valid_file(name, F.col("head"), F.col("size_bytes")).alias("is_valid"))


def ingest_manifest(
    catalog: DataFrame,
    files: DataFrame,
    fetch_log: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """Status per configured source.

    ``fetch_log`` (filename, http_status, content_type) comes from whatever
    fetched the files; without it a file counts as fetched when it exists.
    """
    joined = catalog.join(files, "filename", "left")
    if fetch_log is None:
        joined = joined.withColumns({
            "http_status": F.lit(None).cast("int"), "content_type": F.lit(None).cast("string"),
        })
    else:
        joined = joined.join(fetch_log, "filename", "left")
    cached = F.lit(not force) & (F.col("size_bytes") > presets.CACHED_FILE_BYTES)
    status = (
        F.when(F.col("http_status").isNotNull() & (F.col("http_status") != 200), "failed_http")
        .when(F.col("size_bytes").isNull(), "failed_request")
        .when(cached & F.col("http_status").isNull(), "cached")
        .when(~F.col("is_valid"), "invalid_content")
        .otherwise("downloaded")
    )
    failed = F.col("status").isin("failed_http", "failed_request")
    return joined.withColumn("status", status).select(
        *presets.SOURCE_COLUMNS, "path", "status",
        F.when(failed, F.lit(0)).otherwise(F.col("size_bytes")).cast("long").alias("size_bytes"),
        F.coalesce("content_type", F.lit("")).alias("content_type"),
    )
