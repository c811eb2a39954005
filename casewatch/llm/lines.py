"""Line deduplication over documents with two Bloom filters.

1. Hashes of the distinct line keys of each document are written as a table (8 bytes each).
2. Every task reads hashes into two filters: seen in one document, seen in a second one.
   Filters are joined block by block; a bit set in two tasks' first filters goes to the
   second, so no key that two documents hold is ever missed.
3. The second filter goes to all tasks. Its size follows the number of keys up to
   ``most_bits`` and never beyond (64 MB). A table with more keys than fit has more
   false suspects, at most all keys; the result is the same.
4. Only suspected keys are shuffled, by their SHA-256: documents are counted, combined
   inside each task, and the document that keeps the line is chosen.
5. Documents meet the list of keys they lose and are rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import bloom, common
from casewatch.session import materialize

BLANKS = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
BITS_A_KEY, LEAST_BITS, MOST_BITS = 8, 2**20, 2**29
BLOCK_WORDS = 2**11


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """Line without outer blanks, A to Z lower-cased; None where it is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < least_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars):
        return None
    return key


def keys_of(text: bytes, least_chars: int) -> set[bytes]:
    found = {key_of(line, least_chars) for line in text.split(b"\n")}
    found.discard(None)
    return found


def hash_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """Hashes of each document's distinct keys; ``docs`` has body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, len(batch), 500):
                lists = []
                for body in batch["body"][at:at + 500]:
                    lists.append(np.fromiter(map(digest, keys_of(body.as_py(), least_chars)), np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], ["hashes"])
        common.give_back()

    return materialize(docs.select("body").mapInArrow(run, "hashes array<bigint>"))


def filter_blocks(hashes: DataFrame, words: int) -> DataFrame:
    """Both filters over all rows of ``hashes``, as blocks that hold any bit."""
    block_words = min(BLOCK_WORDS, words)
    names = ["block", "once", "twice"]

    def rows(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        grid, grid_2 = once.reshape(-1, block_words), twice.reshape(-1, block_words)
        used = np.flatnonzero(grid.any(axis=1) | grid_2.any(axis=1))
        for at in range(0, len(used), 64):
            part = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([
                pa.array(part, pa.int32()), pa.array([grid[i].tobytes() for i in part], pa.binary()),
                pa.array([grid_2[i].tobytes() for i in part], pa.binary())], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                flat = batch["hashes"].slice(at, 1000).flatten()
                bloom.add_twice(once, twice, flat.to_numpy(zero_copy_only=False).view(np.uint64))
        yield from rows(once, twice)
        del once, twice
        common.give_back()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, block = np.zeros(block_words, np.uint64), np.zeros(block_words, np.uint64), None
        for batch in batches:
            block = batch["block"][0].as_py()
            for a, b in zip(batch["once"], batch["twice"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
                twice |= b | (once & a)
                once |= a
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([once.tobytes()]), pa.array([twice.tobytes()])], names)

    schema = "block int, once binary, twice binary"
    return materialize(hashes.mapInArrow(build, schema).groupBy("block").applyInArrow(joined, schema))


def suspects(docs: DataFrame, twice: np.ndarray, least_chars: int) -> DataFrame:
    """A row per document and suspected key: document key, SHA-256 of the line key."""
    held = docs.sparkSession.sparkContext.broadcast(twice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                keys, owner = [], []
                for i, body in enumerate(part["body"]):
                    own = keys_of(body.as_py(), least_chars)
                    keys.extend(own)
                    owner.extend([i] * len(own))
                hit = np.flatnonzero(bloom.holds(held.value, np.fromiter(map(digest, keys), np.uint64, len(keys))))
                sha = [hashlib.sha256(keys[i]).digest() for i in hit]
                rows = pa.array(np.asarray(owner, np.int64)[hit] if len(hit) else [], pa.int64())
                yield pa.RecordBatch.from_arrays([part["k"].take(rows), pa.array(sha, pa.binary())], ["k", "line"])
        common.give_back()

    return materialize(docs.select("k", "body").mapInArrow(run, "k struct<id: long, h1: long, h2: long>, line binary"))


def rewrite(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Text without the lines whose key is in ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                total, dropped, kept = [], [], []
                for body, gone in zip(part["body"], part["gone"], strict=True):
                    raw, gone = body.as_py(), set(gone.as_py() or ())
                    lines = raw.split(b"\n")
                    stay = lines
                    if gone:
                        keys = (key_of(line, least_chars) for line in lines)
                        stay = [line for line, key in zip(lines, keys, strict=True) if key is None or hashlib.sha256(key).digest() not in gone]
                    total.append(len(lines))
                    dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay) if len(stay) < len(lines) else raw)
                made = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *made], ["doc_id", "n_lines", "n_dropped", "kept"])
        common.give_back()

    return run


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
    bits_a_key: int = BITS_A_KEY, most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text that is left.

    A line's key is the line without outer blanks, A to Z lower-cased. Keys of at least
    ``least_chars`` code points in at least ``least_docs`` documents (two or more) lose all
    their lines except in the largest identifier that holds them. Every row is a document,
    so rows that repeat one count each; rows that share the largest identifier all keep the
    line, and a null identifier is the smallest. A null or empty text is one empty line; a
    very long text is split whole, in one task; an empty table gives no rows; other columns
    are not read.
    """
    if least_docs < 2:
        raise ValueError("the filters tell apart one document from two")
    body = F.coalesce(F.col(text), F.lit("")).cast("string")
    whole = common.only(docs, doc_id=F.col(doc_id).cast("long"), k=common.text_key(F.col(doc_id), body), body=body.cast("binary"))
    hashes = hash_table(whole, least_chars)
    count = hashes.agg(F.sum(F.size("hashes"))).first()[0] or 0
    words = bloom.size_for(count, bits_a_key, LEAST_BITS, most_bits)
    twice = bloom.from_blocks(filter_blocks(hashes, words), words, "twice")
    met = suspects(whole, twice, least_chars)
    # A table, so that the join may split a line that a third of the documents hold.
    frequent = materialize(met.groupBy("line").agg(F.count("*").alias("n"), F.max("k.id").alias("keeper")).filter(F.col("n") >= least_docs).select("line", "keeper"))
    lost = met.join(frequent, "line").filter("k.id <> keeper").groupBy("k").agg(F.collect_set("line").alias("gone"))
    joined = whole.join(materialize(lost), "k", "left").select("doc_id", "body", "gone")
    made = joined.mapInArrow(rewrite(least_chars), "doc_id long, n_lines long, n_dropped long, kept binary")
    return made.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("text"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = drop_repeated_lines(common.read(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = {"op12_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
    unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
told AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_line_dedup": op12_line_dedup}
