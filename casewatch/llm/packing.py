"""Hierarchical packing: documents go to tiers of context sizes, tiers are packed, gaps filled.

Each task packs the documents it reads, so no text is shuffled and no key can
run hot. A task holds one window of documents at a time:

1. A document longer than the largest tier is cut into full sequences of it; the
   rest goes to the smallest tier that holds it. Every tier has its own list.
2. From the largest tier down, each rest of a tier starts a sequence of that tier's
   size. The gap is filled best fit, longest piece that fits first, which only the
   shorter tiers hold (and, in the smallest tier, the tier itself).
3. A gap that no piece fits is filled by cutting the shortest piece left; the
   remainder goes back to the tier of its new length.
4. A rest that it and all shorter pieces together cannot fill waits for the next
   window. At the end of the partition what waits, less than one sequence of the
   largest tier, is cut so that at most one sequence, of the smallest tier, is padded.

Sequences of one tier are dealt to step groups of ``step_tokens`` tokens each, so
every step of a tier costs the same. Tasks number their sequences by tier; the
counts of all tasks (one row a task and tier) make these numbers global, so that
only the last group of a tier in the whole table is not full.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common
from casewatch.session import materialize

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 2**19
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, padding int, step_group long"
)
MADE = SCHEMA + ", nth long"
TASK_BITS = 33
#: Bytes of texts that are tokenized together; a longer text alone.
TOGETHER = 2**24
#: Latin letters lie below this code point.
LATIN = 0x250
#: Words whose characters neither change nor join when normalised, but for their case, and are no white space.
PLAIN = r"^[!-~\x{A1}-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}]*$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def letters_encoder(tokenizer: Any) -> Callable:
    """Ids of words of lower-case Latin letters by the tokenizer's model: its other steps leave them as they are."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenize, in_bytes = tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    table = {ord(c): in_bytes(c)[0][0] for c in map(chr, range(LATIN))}

    def encode(batch: list[list[str]]) -> list[list[list[int]]]:
        return [[[t.id for t in tokenize(w if w.isascii() else w.translate(table))] for w in words] for words in batch]

    return encode


class WordTokens:
    """Token ids (little-endian unsigned 32-bit) of texts, by pieces of words remembered up to ``limit``.

    The tokenizer drops white space and never joins text across it, so a text's ids are
    those of its words in order. Of several texts together each different word is looked
    at once: a word of plain characters is lower-cased and split by the tokenizer's own
    pattern, any other word is one piece. Pieces met for the first time are tokenized, those
    of lower-case letters by the tokenizer's model alone. Of two generations of pieces the
    older one is forgotten when the younger holds half of ``limit``; pieces met again move to it.
    Texts that bring more than ``limit`` leave none behind.
    """

    def __init__(self, path: str, limit: int = 800_000) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        steps = form["pre_tokenizer"].get("pretokenizers", [form["pre_tokenizer"]])
        self.pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.added = [t["content"] for t in form["added_tokens"]]
        self.encode = tokenizer.encode_batch
        self.encode_letters = letters_encoder(tokenizer)
        self.limit = limit
        self.now: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def pieces(self, words: pa.Array) -> pa.ListArray:
        """The pieces of each word; empty ones have no ids."""
        plain = pc.match_substring_regex(words, PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        low = pc.utf8_lower(pc.if_else(plain, words, ""))
        letters = pc.utf8_is_alpha(low)
        split = pc.replace_substring_regex(pc.if_else(letters, "", low), self.pattern, r"\0 ")
        return pc.split_pattern(pc.if_else(plain, pc.if_else(letters, low, split), words), " ")

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces that ``now`` lacks; those of the older generation move."""
        letters: list[str] = []
        other: list[str] = []
        for piece in pieces:
            if piece not in self.now:
                if piece in self.old:
                    self.now[piece] = self.old[piece]
                elif piece.isalpha() and (piece.isascii() or ord(max(piece)) < LATIN) and piece == piece.lower():
                    letters.append(piece)
                else:
                    other.append(piece)
        for at in range(0, len(letters), 5000):
            new = letters[at:at + 5000]
            found = self.encode_letters([new])[0]
            self.keep(new, list(chain.from_iterable(found)), list(map(len, found)))
        for at in range(0, len(other), 5000):
            new = other[at:at + 5000]
            one = self.encode([new], is_pretokenized=True, add_special_tokens=False)[0]
            self.keep(new, one.ids, np.bincount(np.asarray(one.word_ids, np.int64), minlength=len(new)))

    def keep(self, pieces: list[str], ids: list[int], counts: list[int] | np.ndarray) -> None:
        flat, start = np.asarray(ids, "<u4").tobytes(), 0
        for piece, end in zip(pieces, (4 * np.cumsum(counts, dtype=np.int64)).tolist(), strict=True):
            self.now[piece] = flat[start:end]
            start = end

    def texts(self, texts: list[str] | pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        listed = self.pieces(words.dictionary)
        pieces = listed.flatten().dictionary_encode()
        self.learn(names := pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        found = pa.array(list(map(self.now.__getitem__, names)), pa.large_binary())
        found = grouped(found.take(pieces.indices), listed)
        if len(self.now) > self.limit // 2:
            self.now, self.old = {"": b""}, self.now if len(self.now) <= self.limit else {}
        return grouped(found.take(words.indices), split).to_pylist()


def grouped(parts: pa.LargeBinaryArray, lists: pa.Array) -> pa.LargeBinaryArray:
    """The parts of each list joined to one; ``lists`` tells how many each has."""
    ends = np.frombuffer(parts.buffers()[1], np.int64)[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
    return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), parts.buffers()[2]])


@cache
def encoder(path: str) -> WordTokens:
    """One per Python worker; its tasks share the tokenizer and the words it remembers."""
    return WordTokens(path)


class Packer:
    """Packs pieces ``(document, start, ids)`` into sequences; holds only rests between windows."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int) -> None:
        self.tiers, self.step_tokens, self.base = tiers, step_tokens, base
        self.top, self.next = tiers[-1], 0
        # Per tier: rests sorted by length, and their tokens.
        self.rests: dict[int, list[tuple[int, int, tuple, int, bytes]]] = {t: [] for t in tiers}
        self.tokens = dict.fromkeys(tiers, 0)
        self.order = 0
        self.made = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def tier(self, length: int) -> int:
        return self.tiers[bisect.bisect_left(self.tiers, length)]

    def wait(self, doc: tuple, start: int, ids: bytes) -> None:
        self.order += 1
        n = len(ids) // 4
        bisect.insort(self.rests[self.tier(n)], (n, self.order, doc, start, ids))
        self.tokens[self.tier(n)] += n

    def take(self, tier: int, at: int) -> tuple:
        rest = self.rests[tier].pop(at)
        self.tokens[tier] -= rest[0]
        return rest

    def fitting(self, gap: int) -> tuple | None:
        """The longest rest that fits."""
        for tier in reversed(self.tiers[:self.tiers.index(self.tier(gap)) + 1]):
            at = bisect.bisect_left(self.rests[tier], (gap + 1,)) - 1
            if at >= 0:
                return self.take(tier, at)
        return None

    def waiting(self, size: int) -> int:
        """Tokens in the lists of a tier and the shorter ones."""
        return sum(n for tier, n in self.tokens.items() if tier <= size)

    def add(self, doc_id, ids: bytes) -> None:
        total, full = len(ids) // 4, 4 * self.top
        doc = (doc_id, total)
        for at in range(0, len(ids) - full + 1, full):
            self.sequence(self.top, [(doc, at // 4, ids[at:at + full])])
        if rest := len(ids) % full:
            self.wait(doc, total - rest // 4, ids[-rest:])

    def sequence(self, size: int, pieces: list) -> None:
        per_step = max(1, self.step_tokens // size)
        nth = self.made[size]
        group = (nth // per_step) * len(self.tiers) + self.tiers.index(size)
        self.made[size] += 1
        padding = size - sum(len(p[2]) for p in pieces) // 4
        at = 0
        for (doc_id, total), start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.base + self.next, at, size, padding, self.base + group, nth))
            at += n
        self.next += 1

    def fill(self, size: int) -> None:
        """One sequence of ``size``: the longest rest that fits, again and again, then a cut."""
        gap, pieces = size, []
        while gap and self.waiting(self.top):
            if rest := self.fitting(gap):
                n, _, doc, start, ids = rest
            else:
                shortest = next(t for t in self.tiers if self.rests[t])
                _, _, doc, start, ids = self.take(shortest, 0)
                self.wait(doc, start + gap, ids[4 * gap:])
                n, ids = gap, ids[:4 * gap]
            pieces.append((doc, start, ids))
            gap -= n
        self.sequence(size, pieces)

    def flush(self, last: bool) -> list[tuple]:
        for size in reversed(self.tiers):
            while self.rests[size] and self.waiting(size) >= size:
                self.fill(size)
        if last:
            for size in reversed(self.tiers):
                if self.waiting(self.top) >= size:
                    self.fill(size)
            while self.waiting(self.top):
                self.fill(self.tiers[0])
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, window: int = 2048,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    A null text is empty and packs as its end id alone; a very long text is cut into
    full sequences; rows that repeat a document are packed each; an empty table gives
    no rows; other columns are not read. ``sequence_id`` holds the partition in its
    upper bits, so sequences of different tasks never meet; step groups span tasks.
    """
    if list(tiers) != sorted(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are ascending powers of two")
    path, end = tokenizer or tokenizer_path(), np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << TASK_BITS)
        for batch in batches:
            names, texts = batch.column("i").to_pylist(), batch.column("t")
            for start, n in common.slices(texts, len(batch), TOGETHER):
                for at, ids in enumerate(words.texts(texts.slice(start, n)), start + 1):
                    packer.add(names[at - 1], ids + end)
                    if at % window == 0 or at == len(batch):
                        yield frame(packer.flush(last=False))
        yield frame(packer.flush(last=True))
        common.give_back()

    narrow = common.only(docs, i=F.col(doc_id).cast("long"), t=F.coalesce(F.col(text), F.lit("")))
    return in_steps(materialize(narrow.mapInArrow(run, MADE)), tiers, step_tokens)


def in_steps(rows: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """Step groups over all tasks: a sequence's number follows those of its tier in the tasks before."""
    task = F.shiftright("sequence_id", TASK_BITS).alias("task")
    counts = rows.groupBy(task, "tier").agg((F.max("nth") + 1).alias("n")).collect()
    before, starts = dict.fromkeys(tiers, 0), []
    for part, tier, n in sorted(counts):
        starts.append((part, tier, before[tier], max(1, step_tokens // tier), tiers.index(tier)))
        before[tier] += n
    table = rows.sparkSession.createDataFrame(starts, "task long, of_tier int, before long, per_step int, place int")
    on = (F.shiftright("sequence_id", TASK_BITS) == F.col("task")) & (F.col("tier") == F.col("of_tier"))
    group = F.floor((F.col("before") + F.col("nth")) / F.col("per_step")) * len(tiers) + F.col("place")
    joined = rows.drop("step_group").join(F.broadcast(table), on)
    return joined.withColumn("step_group", group).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def frame(rows: list[tuple]) -> pa.RecordBatch:
    columns = [c.split() for c in MADE.split(", ")]
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, columns, strict=True)], [n for n, _ in columns])


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(common.read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_packing": op7_packing}
