"""Sets of artefacts that become visible together.

A release is a folder of its own below a root. When all of it is written, its files are
listed in a manifest and a pointer file of the root is replaced by a rename. Readers
follow the pointer, so they meet one whole release, whatever happens to a writer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTER, MANIFEST = "CURRENT", "_manifest"


def begin(root: str) -> str:
    """Folder of a new release, not visible yet."""
    return f"{root}/releases/{uuid.uuid4().hex}"


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a release: path inside it and size. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.substring_index(F.col("path"), f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return found.select(inside.alias("file"), F.col("length").alias("size_bytes")).filter(~F.col("file").startswith(MANIFEST))


def commit(spark: SparkSession, root: str, folder: str) -> None:
    """List the release in its manifest, then let the pointer of the root name it."""
    contents(spark, folder).write.parquet(f"{folder}/{MANIFEST}")
    replace_file(spark, f"{root}/{POINTER}", folder.rstrip("/").rsplit("/", 1)[-1])


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """A file with one line, written beside and renamed over the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(beside, False)
    out.write(bytearray(f"{text}\n", "utf-8"))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, how)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the release the pointer names; None for a root without releases."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return f"{root}/releases/{spark.read.text(f'{root}/{POINTER}').first()[0]}"


def missing(spark: SparkSession, root: str) -> DataFrame:
    """Files of the current release's manifest that are gone or have another size."""
    folder = current(spark, root)
    listed = spark.read.parquet(f"{folder}/{MANIFEST}")
    return listed.join(contents(spark, folder), ["file", "size_bytes"], "left_anti")


def drop_others(spark: SparkSession, root: str) -> int:
    """Delete the releases the pointer does not name; for when nobody reads or writes them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/releases")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    keep = (current(spark, root) or "").rsplit("/", 1)[-1]
    gone = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName() != keep]
    for path in gone:
        system.delete(path, True)
    return len(gone)
