"""Blocked Bloom filters as arrays of 64-bit words: a hash sets four bits of one word.

Membership never misses what was added. Filters of one size are joined word by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from casewatch.llm import common

BITS_EACH = 4


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of each hash and its bits in that word; ``words`` is a power of two."""
    spread = common.mixed(hashes)
    mask = np.zeros(len(hashes), np.uint64)
    for i in range(BITS_EACH):
        mask |= np.uint64(1) << ((spread >> np.uint64(6 * i)) & np.uint64(63))
    return ((spread >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at, mask = places(hashes, len(bits))
    return (bits[at] & mask) == mask


def add(bits: np.ndarray, hashes: np.ndarray) -> None:
    at, mask = places(hashes, len(bits))
    np.bitwise_or.at(bits, at, mask)


def add_twice(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """Add one document's distinct hashes; what ``once`` held before goes to ``twice``.

    Hashes of several documents may come together: those that repeat go to ``twice`` too.
    """
    kinds, counts = np.unique(hashes, return_counts=True)
    again = holds(once, kinds) | (counts > 1)
    add(twice, kinds[again])
    add(once, kinds[~again])


def size_for(items: int, bits_an_item: int, least: int, most: int) -> int:
    """Words of a filter for ``items``: a power of two between the two bounds, in bits."""
    bits = 1 << max(items * bits_an_item - 1, 1).bit_length()
    return min(max(bits, least), most) // 64


def from_blocks(blocks: DataFrame, words: int, column: str) -> np.ndarray:
    """The filter on the driver, ``words`` of 8 bytes, from rows (block, bytes of equal length)."""
    bits = np.zeros(words, np.uint64)
    for batch in blocks.select("block", column).toArrow().to_batches():
        for block, raw in zip(batch["block"].to_pylist(), batch[column], strict=True):
            part = np.frombuffer(raw.as_buffer(), "<u8")
            bits[block * len(part):(block + 1) * len(part)] |= part
    return bits
