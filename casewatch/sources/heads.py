"""The first bytes of files, read without the rest."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 2**16


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as Spark lists them: URI, path, size. No content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("size_bytes"))


def read_head(stream: BinaryIO, size: int, whole_line: bool) -> bytes:
    """The first ``size`` bytes; with ``whole_line`` as many more as the first line has."""
    head = stream.read(size)
    while whole_line and b"\n" not in head and b"\r" not in head:
        more = stream.read(CHUNK)
        if not more:
            break
        head += more
    return head


def file_heads(spark: SparkSession, path: str, size: int, whole_line: bool = False) -> DataFrame:
    """Listed files with their first bytes (``head``), opened by the tasks that hold their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                system, place = pyarrow.fs.FileSystem.from_uri(batch["file"][at].as_py())
                with system.open_input_stream(place, compression=None, buffer_size=0) as stream:
                    head = read_head(stream, size, whole_line)
                row = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([row["file"], row["path"], row["size_bytes"], pa.array([head], pa.binary())], ["file", "path", "size_bytes", "head"])

    return listed(spark, path).mapInArrow(run, "file string, path string, size_bytes long, head binary")


def is_utf8(head: bytes) -> bool:
    """Valid UTF-8 so far; a character cut at the end counts as valid."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=False)
    except UnicodeDecodeError:
        return False
    return True


def header_line(head: bytes) -> tuple[str, bool]:
    """First line without byte-order mark and line end; whether the head is valid UTF-8."""
    valid = is_utf8(head)
    line = head.removeprefix(codecs.BOM_UTF8).replace(b"\r", b"\n").split(b"\n", 1)[0]
    return line.decode("utf-8" if valid else "iso-8859-1", "replace"), valid


def headers(spark: SparkSession, path: str, encoding: str | None = None, size: int = CHUNK) -> DataFrame:
    """Header line per file and whether its head is valid UTF-8: file, size_bytes, header, utf8.

    With ``encoding`` the line is decoded by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [header_line(head.as_py()) for head in batch["head"]]
            if encoding:
                raw = [head.as_py().replace(b"\r\n", b"\n") for head in batch["head"]]
                found = [(h.decode(encoding, "replace").removeprefix("﻿").split("\n", 1)[0], True) for h in raw]
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["size_bytes"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())],
                ["file", "size_bytes", "header", "utf8"])

    return file_heads(spark, path, size, whole_line=True).mapInArrow(run, "file string, size_bytes long, header string, utf8 boolean")
