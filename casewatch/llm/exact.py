"""Exact deduplication with a keyed streaming state on disk.

Documents stream through an aggregation keyed by digest. Its state lives in RocksDB,
never expires, and holds per digest the stable identifier that stays, the locator of
its content and the number of arrivals. Copies are merged inside each task before
they reach the state, so a hot text is one row per task. A later run over the same
``state_dir`` reads only files that are new.

A digest met more than once is a hit. The full bytes of every hit are compared with
the bytes at the state's locator. Texts that differ there form groups of their own,
so no digest, however weak, merges different texts.

Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casewatch.llm import common
from casewatch.session import materialize, scratch_path

#: State on disk, in bounded memory; without preallocated log files, 4 MB in every partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(rows: DataFrame) -> DataFrame:
    """Digest and stay-order of each row; ``rows`` has id, digest, h1, h2 and comes from files."""
    place = F.struct("id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "h1", "h2")
    return rows.select("digest", place.alias("row"))


def stream_state(spark: SparkSession, path: str, schema: StructType, parts: Callable[[DataFrame], DataFrame], state_dir: str | None) -> DataFrame:
    """Run all files under ``path`` through the keyed state; then the state itself, one row per digest."""
    state_dir = state_dir or scratch_path(spark)
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        # As a pattern, the path may be a folder or a single file.
        rows = parts(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
        keyed = arrivals(rows).groupBy("digest").agg(F.max("row"), F.count("*"))
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    held = spark.read.format("statestore").load(state_dir)
    return materialize(held.select("key.digest", F.col("value.max").alias("stays"), F.col("value.count").alias("n")))


def different_bytes(contents: DataFrame, state: DataFrame) -> DataFrame:
    """Digest and content key of texts that share a digest but not the bytes at its locator."""
    hits = state.filter("n > 1").select("digest", "stays")
    met = materialize(
        contents.join(hits, "digest").select("digest", "id", "h1", "h2", "text", F.expr(
            "id <=> stays.id AND h1 = stays.h1 AND h2 = stays.h2").alias("holds"))
    )
    holders = materialize(met.filter("holds").groupBy("digest").agg(F.max("text").alias("held")))
    # Written before it is made distinct, so that the join may split a hot digest.
    apart = materialize(met.join(holders, "digest").filter(F.col("text") != F.col("held")).select("digest", "h1", "h2"))
    return apart.distinct()


def resolve(rows: DataFrame, state: DataFrame, other: DataFrame) -> DataFrame:
    """One row per arrival: the identifier that stays, group size, whether it stays itself."""
    if other.isEmpty():
        return staying(rows.join(state, "digest"))
    key = ["digest", "h1", "h2"]
    flat = rows.select("digest", "row.h1", "row.h2", "row")
    apart = flat.join(other, key)
    groups = apart.groupBy(*key).agg(F.max("row").alias("stays"), F.count("*").alias("n"))
    fewer = apart.groupBy("digest").agg(F.count("*").alias("less"))
    main = state.join(fewer, "digest", "left").select("digest", "stays", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
    return staying(flat.join(other, key, "left_anti").join(main, "digest")).unionByName(staying(apart.join(groups, key)))


def staying(joined: DataFrame) -> DataFrame:
    return joined.select("digest", "row", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays")).alias("kept"))


def parts_of(doc_id: str, text: str, digest: Digest) -> Callable[[DataFrame], DataFrame]:
    body = F.coalesce(F.col(text), F.lit(""))

    def parts(df: DataFrame) -> DataFrame:
        return df.select(
            F.col(doc_id).cast("long").alias("id"), digest(body).alias("digest"), F.xxhash64(body).alias("h1"),
            F.xxhash64(body, F.lit(1)).alias("h2"), body.alias("text"), "_metadata")

    return parts


def deduplicate_files(
    spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", digest: Digest = sha256, state_dir: str | None = None,
) -> DataFrame:
    """Decisions for a Parquet table, streamed file by file: one row per document.

    Of equal texts the row with the largest identifier stays; a null identifier is
    the smallest; of rows that repeat both, one stays. A null text equals an empty
    one. An empty table gives no rows; other columns are not read.
    """
    schema = spark.read.parquet(path).schema
    narrow = StructType([f for f in schema if f.name in (doc_id, text)])
    parts = parts_of(doc_id, text, digest)
    state = stream_state(spark, path, narrow, parts, state_dir)
    contents = parts(spark.read.schema(narrow).parquet(path))
    return resolve(arrivals(contents), state, different_bytes(contents, state))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Digest = sha256, state_dir: str | None = None) -> DataFrame:
    """Documents that stay, same columns; ``docs`` is any frame.

    Identifiers and digests are written as files and stream through the state; texts
    are read from ``docs`` for the byte check alone.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    contents = docs.select(
        F.col(doc_id).cast("long").alias("id"), digest(body).alias("digest"), F.xxhash64(body).alias("h1"),
        F.xxhash64(body, F.lit(1)).alias("h2"), body.alias("text"), F.struct("*").alias("r"))
    path = scratch_path(spark)
    contents.drop("text", "r").write.parquet(path)
    written = spark.read.parquet(path)
    state = stream_state(spark, path, written.schema, lambda df: df.select("*", "_metadata"), state_dir)
    decided = resolve(arrivals(written.select("*", "_metadata")), state, different_bytes(contents.drop("r"), state))
    kept = decided.filter("kept").select("digest", "row.id", "row.h1", "row.h2")
    same = "a.digest = b.digest AND a.id <=> b.id AND a.h1 = b.h1 AND a.h2 = b.h2"
    stays = contents.drop("text").alias("a").join(kept.alias("b"), F.expr(same), "left_semi")
    # Rows equal in identifier and text share a key: one of them stays.
    one = stays.groupBy("digest", "id", "h1", "h2").agg(F.first("r").alias("r"))
    return one.select(*[F.col(f"r.`{c}`") for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = deduplicate_files(spark, f"{folder}/documents.parquet")
    return decided.select(F.col("row.id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = {"op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_exact_dedup": op10_exact_dedup}
