"""Raw CSV and processed-dataset scans."""

from __future__ import annotations

import csv
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casewatch import presets
from casewatch.sources import release
from casewatch.sources.heads import headers

DELIMITERS = [",", ";", "\t", "|"]
CORRUPT = "_malformed"
ROW_ORDER = "row_order"


def sniff_delimiter(line: str) -> str:
    return max(DELIMITERS, key=line.count)


def decoded(cell: str | Column) -> Column:
    """Cell read one character per byte: its bytes as UTF-8 where they are, else as they stand."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    raw = F.encode(cell, "ISO-8859-1").cast("string")
    ascii_only = F.octet_length(cell) == F.length(cell)
    return F.when(ascii_only, cell).when(F.is_valid_utf8(raw), raw).otherwise(cell)


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """All-string scan: long lines dropped, short ones padded, NA texts null.

    ``path`` is a file or a folder of files. Every file is read by its own header,
    which becomes an explicit schema, so nothing is inferred; files of one header
    are one scan, and columns of different headers are matched by name.
    ``row_order`` numbers the rows in source order, files by path, and keeps that
    order through any later shuffle: see ``row_place``.

    Only first bytes are read to know header, delimiter and encoding; bodies are read
    once. Without ``encoding``, a file whose head is no UTF-8 is Latin-1. The bodies of
    the others are read byte by byte as they stand, and a cell that is no UTF-8 is
    Latin-1: so a Latin-1 file whose first accent comes late is read right.
    """
    # One row per file, as any scan of them holds on the driver.
    found = sorted(headers(spark, path, encoding).collect(), key=lambda r: r["file"])
    found = [r for r in found if r["size_bytes"]]
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField(ROW_ORDER, T.DecimalType(38, 0))]))
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in found:
        groups.setdefault((row["header"], row["utf8"]), []).append(row["file"])
    # Kept on the driver as the scans keep their files, so rows need not be shuffled to meet it.
    ranks = F.broadcast(spark.createDataFrame(pa.table({"_file": [r["file"] for r in found], "_rank": pa.array(range(len(found)), pa.int32())})))
    parts = []
    for (line, utf8), names in groups.items():
        source = path if len(groups) == 1 else names
        parts.append(_scan(spark, source, line, delimiter, encoding, multi_line, mixed=utf8 and not encoding))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(found) == 1:
        placed = whole.withColumn("_rank", F.lit(0))
    else:
        placed = whole.join(ranks, "_file")
    columns = [c for c in whole.columns if c not in ("_file", "_block", "_line")]
    return placed.select(*[F.col(f"`{c}`") for c in columns], row_place("_rank", "_block", "_line").alias(ROW_ORDER))


def row_place(rank: str, block: str, line: str) -> Column:
    """Fixed-width place of a row: file, split inside the file, row inside the split.

    Splits are planned by size, so a partition number says nothing of the order;
    inside a split rows are numbered as they stand.
    """
    whole = "decimal(38,0)"
    by_file = F.col(rank).cast(whole) * F.lit(Decimal(10**26)).cast("decimal(27,0)")
    by_block = F.col(block).cast("decimal(17,0)") * F.lit(10**10).cast("decimal(11,0)")
    inside = F.col(line).bitwiseAND(F.lit(2**33 - 1))
    return (by_file.cast(whole) + by_block.cast(whole) + inside.cast(whole)).cast(whole)


def _scan(
    spark: SparkSession, path: str | list[str], line: str, delimiter: str | None, encoding: str | None,
    multi_line: bool, mixed: bool,
) -> DataFrame:
    """Files of one header: its columns, and where each row stands; ``mixed`` decodes cell by cell."""
    delimiter = delimiter or sniff_delimiter(line)
    header = next(csv.reader([line], delimiter=delimiter), [])
    width = len(header)
    fields = [T.StructField(f"_{i}", T.StringType()) for i in range(width)]
    raw = spark.read.csv(
        path, schema=T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]),
        header=True, enforceSchema=True, sep=delimiter, encoding=encoding or "ISO-8859-1", escape='"',
        mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=multi_line,
        nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    # A malformed line is short or long; only delimiters outside quotes count.
    unquoted = F.regexp_replace(F.col(CORRUPT), '"([^"]|"")*"', "")
    surplus = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit("")))
    # Always true, and reads a column: Spark refuses scans of the malformed line alone, such as a plain count.
    readable = F.coalesce(F.length("_0"), F.lit(0)) >= 0
    kept = raw.filter(readable & (F.col(CORRUPT).isNull() | (surplus < width)))
    return kept.select(
        *[
            F.when(~F.col(f"_{i}").isin(presets.CSV_NULLS), decoded(f"_{i}") if mixed else F.col(f"_{i}")).alias(name)
            for i, name in enumerate(header)
        ],
        "_file", "_block", "_line",
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def read_processed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Processed dataset: Parquet if present, else CSV as strings; of the current release, if the folder has any."""
    folder = release.current(spark, folder) or folder
    if path_exists(spark, f"{folder}/{name}.parquet"):
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if path_exists(spark, f"{folder}/{name}.csv"):
        return spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=False)
    raise FileNotFoundError(f"no processed dataset {name} in {folder}; run the ETL first")
