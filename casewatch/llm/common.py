"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Null identifiers take this value inside keys; it is no identifier of any table.
NO_ID = -(2**63)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_key(doc_id: Column, text: Column) -> Column:
    """Join key of a document by what it holds.

    Rows that repeat both identifier and text share a key; every operator that
    uses the key gives such rows equal results.
    """
    return F.struct(
        F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit(1)).alias("h2"),
    )


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns alone, so that no other column can clash with those an operator adds."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (multiply and fold, twice)."""
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(30))) * MIX
        x = (x ^ (x >> np.uint64(27))) * GOLDEN
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word, remembered; emptied when it has grown past ``limit`` words."""

    def __init__(self, limit: int = 500_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per run of ``n`` words; a shorter text is one run of all its words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + hashes[i:i + count]) * GOLDEN
    return mixed(out)


def slices(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and number of successive rows: at most ``rows``, and ``size`` bytes unless one text has more."""
    ends = np.cumsum([0, *(pc.binary_length(texts).fill_null(0).to_pylist())])
    start = 0
    while start < len(texts):
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, ends[start] + size, "right")) - 1))
        yield start, stop - start
        start = stop


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker stays beside its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


Batches = Iterator
