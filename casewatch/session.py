"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above 8000 bytes are never compiled to machine code;
    # wide cleaning projections then run faster as several small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_made: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults that a running session accepts."""
    for key, value in DEFAULTS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("casewatch")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.debug.maxToStringFields": "200",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    """One folder per process."""
    return tempfile.mkdtemp(prefix="casewatch-")


def scratch_path(spark: SparkSession) -> str:
    """Path of a new folder inside the shared one."""
    _made.append(f"{shared_folder(spark)}/casewatch-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, spread_by: list[str] | None = None) -> DataFrame:
    """Compute once into a table of the shared folder and read that.

    For a frame several later jobs read. The lineage ends at the files, which
    outlive any executor. Unlike a checkpoint they are columnar and carry
    sizes, so later plans prune columns and choose joins by size.
    ``spread_by`` rebalances the rows, so that partitions follow their size. The
    table stays until ``drop_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    (df.hint("rebalance", *spread_by) if spread_by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this process made in the shared folder; how many they were.

    For the owner of the job, once nothing reads them any more. ``since`` spares the first
    ones, by their number (see ``scratch_count``).
    """
    count = len(_made) - since
    while len(_made) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def scratch_count() -> int:
    return len(_made)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each query inside deletes its shuffle files when it ends, not when the driver collects its plan.

    For a job of several large writes, whose shuffle files would else lie beside each other.
    """
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


#: For jobs that join wide rows: joins hash their smaller side, if all of its partitions are below this size once
#: shuffled, instead of sorting both.
WIDE_ROWS = {
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


@contextmanager
def wide_job(spark: SparkSession) -> Iterator[None]:
    """Settings for a job of several large writes of wide rows: shuffle files go with their query, joins need no sort."""
    with shuffles_dropped(spark), settings(spark, WIDE_ROWS):
        yield


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside only."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
