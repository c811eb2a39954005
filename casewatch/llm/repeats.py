"""Long repeated byte strings by run-length compressed suffix indexes.

A string of ``length`` bytes that starts at two places holds the same anchor at both:
the ``gram`` bytes with the smallest hash in it, leftmost of equals. So every string
belongs to one anchor, and strings are compared among equal anchors alone.

1. Each text is cut into fragments: for each anchor the bytes of all strings that
   choose it. A table holds their places and hashes, no bytes.
2. Fragments whose anchor stands at one place alone are unique. Fragments with the
   same hash (128 bits with the anchor's) at two places repeat whole.
3. The rest are the ends of repeats: single fragments whose anchor is elsewhere too.
   They, and one copy of the repeated fragments of the same anchors, are dealt by
   anchor to shards. A shard builds the run-length Burrows-Wheeler index of its
   fragments, with suffix samples at run ends, and streams matching statistics from
   them: between two samples a match shrinks by one byte per step. Strings whose
   statistic reaches ``length`` are marked. Only these fragments' bytes are shuffled.
4. An anchor with more than ``hot`` different fragments would not fit a shard: its
   strings are hashed and counted one by one instead, combined inside each task.

Texts are joined with the marks once; those with ends of repeats, the minority, once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common
from casewatch.session import materialize

LENGTH, GRAM, HOT = 200, 32, 16_000
SHARD_BYTES = 2**20
CHUNK = 2**20


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of 8) from every position."""
    n = len(data) - gram + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, gram, 8):
            out = (out ^ (out >> np.uint64(29))) * common.GOLDEN
            out += np.ndarray((n,), "<u8", data, at, (1,)) * common.MIX
    return common.mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, from minima of blocks read both ways."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, 2**64 - 1, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def fragments(texts: list[bytes], length: int, gram: int) -> list[tuple[list, list, list, list]]:
    """Per text: first string of each fragment, number of its strings, anchor hash, fragment hash."""
    out: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in texts]
    data = b"".join(texts)
    if len(data) < length:
        return out
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    hashes = gram_hashes(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | places, length - gram + 1)
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(chosen)) <= np.repeat(ends - length, sizes)[:len(chosen)])
    if not len(starts):
        return out
    anchor = chosen[starts]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    low = starts[cut]
    count = starts[np.r_[cut[1:] - 1, len(starts) - 1]] - low + 1
    owner = np.searchsorted(ends, low, "right")
    local = (low - (ends - sizes)[owner]).tolist()
    anchors = hashes[anchor[cut]].view(np.int64).tolist()
    for t, at, n, a, place in zip(owner.tolist(), local, count.tolist(), anchors, low.tolist(), strict=True):
        own = out[t]
        own[0].append(at)
        own[1].append(n)
        own[2].append(a)
        own[3].append(xxhash.xxh3_64_intdigest(data[place:place + n + length - 1]) - 2**63)
    return out


def fragment_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document, fragments as arrays; computed once. ``docs`` has k and text."""
    names = ["low", "strings", "anchor", "frag"]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """Texts of ``CHUNK`` bytes together (one more may end it), and where they begin in the batch."""
        start, held, size = 0, [], 0
        for i, t in enumerate(texts):
            held.append(common.encoded(t.as_py()))
            size += len(held[-1])
            if size >= CHUNK:
                yield start, held
                start, held, size = i + 1, [], 0
        if held:
            yield start, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in chunks(batch["text"]):
                made = [pa.array(v, k) for v, k in zip(zip(*fragments(part, length, gram), strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["k"].slice(start, len(part)), *made], ["k", *names])
        common.give_back()

    schema = "k struct<id: long, h1: long, h2: long>, low array<int>, strings array<int>, anchor array<bigint>, frag array<bigint>"
    return materialize(docs.select("k", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def suffix_order(data: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Order of all suffixes, each ended by its fragment's end; equal ones by position.

    Ranks of 2, 4, 8 ... bytes by sorting pairs of ranks; only suffixes that still
    share their rank are sorted again.
    """
    n = len(data)
    left = end_of - np.arange(n)
    packed = np.zeros(n, np.uint64)
    wide = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for i in range(7):
        packed = (packed << np.uint64(9)) | np.where(left > i, wide[i:n + i] + np.uint64(1), np.uint64(0))
    order = np.argsort(packed)
    ordered = packed[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 7
    while True:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        at = order[open_]
        ahead = at + width
        live = ahead < end_of[at]
        last = not live.any()
        second = at if last else np.where(live, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        by = np.argsort(key)
        order[open_] = at = at[by]
        if last:
            return order
        key = key[by]
        changed = np.r_[True, key[1:] != key[:-1]]
        new[open_] = changed
        rank[at] = open_[np.flatnonzero(changed)[np.cumsum(changed) - 1]]
        width *= 2


def common_length(data: np.ndarray, end_of: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that two suffixes share, at most ``most``."""
    out = np.zeros(len(a), np.int64)
    room = np.minimum(np.minimum(end_of[a] - a, end_of[b] - b), most)
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    for step, view in ((8, words), (1, data)):
        live = np.flatnonzero(room - out >= step)
        while len(live):
            live = live[view[a[live] + out[live]] == view[b[live] + out[live]]]
            out[live] += step
            live = live[room[live] - out[live] >= step]
    return out


class RunIndex:
    """Run-length Burrows-Wheeler transform of fragments, with suffix samples at run ends.

    The transform is kept as runs. At the first row of a run the suffix and the one
    above it are sampled, at the last row the suffix and the one below; with each goes
    the number of bytes the two share. Inside a run a suffix one byte on has the
    neighbours one byte on, so the samples determine every other row.
    """

    def __init__(self, data: np.ndarray, end_of: np.ndarray, most: int) -> None:
        order = suffix_order(data, end_of)
        n = len(order)
        start = np.zeros(n, bool)
        start[0] = True
        start[1:] = end_of[1:] != end_of[:-1]
        before = np.where(start[order], 256 + np.arange(n), data[order - 1].astype(np.int64))  # a fragment's start is its own letter
        head = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.runs = before[head], np.diff(np.r_[head, n])
        tail = np.r_[head[1:], n] - 1
        self.above = self._samples(data, end_of, order, head, -1, most)
        self.below = self._samples(data, end_of, order, tail, 1, most)

    @staticmethod
    def _samples(data: np.ndarray, end_of: np.ndarray, order: np.ndarray, rows: np.ndarray, side: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        other = rows + side
        fine = (other >= 0) & (other < len(order))
        shared = np.zeros(len(rows), np.int64)
        shared[fine] = common_length(data, end_of, order[rows[fine]], order[other[fine]], most)
        by = np.argsort(order[rows])
        return order[rows][by], shared[by]

    def statistics(self, n: int) -> np.ndarray:
        """For each position, in text order, the longest match with any other position."""
        best = np.zeros(n, np.int64)
        position = np.arange(n)
        for places, shared in (self.above, self.below):
            last = np.searchsorted(places, position, "right") - 1
            np.maximum(best, shared[last] - (position - places[last]), out=best)
        return best


def spans_of(flags: np.ndarray, low: int, length: int) -> list[dict]:
    """Byte intervals that the marked strings of a fragment cover."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [{"start": int(low + a), "end": int(low + b + length - 1)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


MARK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def mark_shard(length: int) -> Callable[[pa.Table], pa.Table]:
    """Marks of single fragments of a shard, by the index over all its fragments."""

    def run(table: pa.Table) -> pa.Table:
        part = table.select(["row", "low", "n", "bytes"]).to_pydict()
        sizes = np.array([len(b) for b in part["bytes"]])
        data = np.frombuffer(b"".join(part["bytes"]), np.uint8)
        ends = np.cumsum(sizes)
        end_of = np.repeat(ends, sizes)
        hit = RunIndex(data, end_of, int(sizes.max())).statistics(len(data)) >= length
        rows, marks = [], []
        for row, low, n, end, size in zip(part["row"], part["low"], part["n"], ends.tolist(), sizes.tolist(), strict=True):
            found = spans_of(hit[end - size:end - length + 1], low, length) if n == 1 else []
            if found:
                rows.append(row)
                marks.append(found)
        del part, data, end_of, hit
        common.give_back()
        return pa.table({"row": pa.array(rows, pa.int64()), "marks": pa.array(marks, MARK)})

    return run


def covered(n: int, marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal intervals of a text that the marks cover."""
    out: list[tuple[int, int]] = []
    for m in sorted((m["start"], min(m["end"], n)) for m in marks):
        if out and m[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], m[1])
        else:
            out.append(m)
    return out


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
DIGEST_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string()]


def digest(text: bytes, marks: list[dict]) -> tuple[int, int, int, str]:
    gone = covered(len(text), marks)
    kept, at = hashlib.sha256(), 0
    for start, end in gone:
        kept.update(text[at:start])
        at = end
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()


FRAGMENT = "struct<anchor: long, n: long, low: int, strings: int, bytes: binary>"


def first_pass(length: int) -> Callable:
    """Results of texts without open fragments; the others pass on, with their fragments' bytes."""
    frag = pa.list_(pa.struct([("anchor", pa.int64()), ("n", pa.int64()), ("low", pa.int32()), ("strings", pa.int32()), ("bytes", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch[at:at + 100]
                results, texts, cut = [], [], []
                for text, marks, members in zip(*(part[n].to_pylist() for n in ("text", "marks", "members")), strict=True):
                    raw = common.encoded(text)
                    open_ = any(m["n"] == 1 for m in members or ())
                    results.append((None,) * 4 if open_ else digest(raw, marks or []))
                    texts.append(text if open_ else None)
                    cut.append([m | {"bytes": raw[m["low"]:m["low"] + m["strings"] + length - 1]} for m in members] if members else None)
                made = [pa.array(v, k) for v, k in zip(zip(*results, strict=True), DIGEST_KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["row"], *made, pa.array(texts, pa.string()), part["marks"], pa.array(cut, frag)],
                    ["doc_id", "row", *[c.split()[0] for c in RESULT.split(", ")], "text", "marks", "members"])
        common.give_back()

    return run


def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [digest(common.encoded(t.as_py()), [*(a.as_py() or []), *(m for part in b.as_py() or [] for m in part)])
                for t, a, b in zip(*(batch[n] for n in ("text", "marks", "more")), strict=True)]
        made = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [()] * 4, DIGEST_KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", *[c.split()[0] for c in RESULT.split(", ")]])
    common.give_back()


def hot_marks(members: DataFrame, length: int) -> DataFrame:
    """Marks at hot anchors: every string of theirs hashed, counted, and the repeated ones found again."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                out = []
                for m in batch[at:at + 500].to_pylist():
                    for i in range(m["strings"]):
                        piece = m["bytes"][i:i + length]
                        out.append((m["row"], m["low"] + i, m["n"], m["anchor"], xxhash.xxh3_64_intdigest(piece) - 2**63))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (zip(*out, strict=True) if out else [()] * 5)], ["row", "start", "n", "anchor", "string"])

    listed = members.mapInArrow(strings, "row long, start long, n long, anchor long, string long")
    twice = listed.groupBy("anchor", "string").agg(F.sum("n").alias("places")).filter("places > 1").select("anchor", "string")
    found = listed.filter("n = 1").join(twice, ["anchor", "string"])
    return found.select("row", F.array(F.struct("start", (F.col("start") + length).alias("end"))).alias("marks"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, digest of what is left.

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in the
    same document or another. A null text is empty; a text shorter than ``length`` is
    untouched; rows that repeat a document remove each other's strings; an empty table
    gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = common.only(docs, doc_id=F.col(doc_id).cast("long"), k=common.text_key(F.col(doc_id), body), text=body)
    table = fragment_table(whole, length, gram)
    places = table.select("row", F.inline(F.arrays_zip("anchor", "frag", "low", "strings")))
    # Tables, not aggregates, on one side of the joins: then a hot anchor can be split.
    met = materialize(table.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("met")).filter("met > 1").select("anchor"))
    twice = materialize(places.join(met, "anchor"))
    kinds = materialize(twice.groupBy("anchor", "frag").agg(F.count("*").alias("n"), F.min(F.struct("row", "low", "strings")).alias("at")))
    per_anchor = materialize(
        kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singles")).filter("kinds > 1 AND singles > 0"))
    members = kinds.join(per_anchor, "anchor").select("anchor", "n", "kinds", "at.*")
    repeated = twice.join(kinds.filter("n > 1").select("anchor", "frag"), ["anchor", "frag"], "left_semi")
    marks = repeated.select("row", F.col("low").cast("long").alias("start"), (F.col("low") + F.col("strings") + (length - 1)).cast("long").alias("end"))
    by_row = marks.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    parts = members.groupBy("row").agg(F.collect_list(F.struct("anchor", "n", "low", "strings")).alias("members"))
    known = table.groupBy("k").agg(F.min("row").alias("row")).join(by_row, "row", "left").join(parts, "row", "left")
    joined = whole.join(known, "k").select("doc_id", "row", "text", "marks", "members")
    schema = f"doc_id long, row long, {RESULT}, text string, marks array<struct<start: long, end: long>>, members array<{FRAGMENT}>"
    passed = materialize(joined.mapInArrow(first_pass(length), schema))
    cut = passed.filter("members IS NOT NULL").select("row", F.inline("members")).join(per_anchor.select("anchor", "kinds"), "anchor")
    size = cut.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    cold = cut.filter(F.col("kinds") <= hot).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = cold.groupBy("shard").applyInArrow(mark_shard(length), "row long, marks array<struct<start: long, end: long>>")
    more = materialize(found.unionByName(hot_marks(cut.filter(F.col("kinds") > hot), length)))
    rest = passed.filter("n_bytes IS NULL").select("doc_id", "row", "text", "marks").join(more.groupBy("row").agg(F.collect_list("marks").alias("more")), "row", "left")
    fields = f"doc_id long, {RESULT}"
    return passed.filter("n_bytes IS NOT NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(rest.select("doc_id", "text", "marks", "more").mapInArrow(last_pass, fields))


def op4_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(common.read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_repeated_strings": op4_repeated_strings}
