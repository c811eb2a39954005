"""Phrase collocation mining with burstable hash containers under a shallow word-id trie.

Each task counts phrases in a trie whose upper nodes go by word id. Below them hash
containers hold the rest of a phrase and its count; a container that grows past ``burst``
entries bursts into a node with a container per next word. When a trie holds ``most``
entries its largest subtrees are spilled whole as sorted runs. Runs are a table in the
shared folder; they are merged by prefix partitions: ranges of (language, phrase) that
hold whole runs of prefixes and are cut by size, so a frequent first word is no hot key.

Not every phrase has to be counted by name. A first pass counts words and pairs in
buckets by hash; a bucket with too few occurrences holds no frequent word or pair. The
second pass counts the words of full buckets and cuts the texts down to stretches all of
whose pairs are in full buckets. Then phrases are counted by length: one of k words can be
frequent only if the k - 1 words at either end of it are, so after each length the
stretches shrink to those whose phrases are all frequent, told by a Bloom filter of the
exact counts. From three words on, a pass over the stretches counts phrases in buckets too,
and only those of full buckets are counted by name. Buckets and filters may keep more than
they must, never less. They follow the input up to fixed sizes (``MOST_BUCKETS``,
``MOST_BITS``), beyond which they keep more; results are the same.

Every task returns a row for each phrase it counts. Counting therefore takes as many tasks
as the session has cores, or more if one had to read over ``TASK`` bytes, not one per file
split: the rows follow the number of phrases, not that times the number of splits.

All scores come from exact counts, in decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewatch.llm import bloom, common
from casewatch.session import materialize

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
NO_LANG = "und"
#: Ends a piece: a byte that no UTF-8 text holds.
MARK = b"\xff"
#: Upper case and tab folded, signs that end a piece as marks: all by one table.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + MARK * 10)
BURST, MOST, WAITING = 2**12, 200_000, 100_000
BITS_A_PHRASE, LEAST_BITS, MOST_BITS = 16, 2**16, 2**28
LEAST_BUCKETS, MOST_BUCKETS, BLOCK = 2**16, 2**25, 2**16
#: Bytes of text that are worked on together.
SLICE = 2**20
#: Bytes of text that a task which counts should read at most.
TASK = 2**31


class Node:
    """Burst container: what is below, by word id, and the count of the phrase that ends here."""

    __slots__ = ("children", "here")

    def __init__(self, here: int = 0) -> None:
        self.children: dict[int, Below] = {}
        self.here = here


#: Under a word: the count of a phrase that ends with it, a container of rests, or a node.
Below = int | dict[bytes, int] | Node


class PhraseTrie:
    """Counts of phrases of one task, in bounded memory."""

    def __init__(self, burst: int = BURST, most: int = MOST) -> None:
        self.burst, self.most = burst, most
        self.empty()

    def empty(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.roots: dict[str, Node] = {}
        self.size = 0

    def id(self, word: bytes) -> int:
        found = self.ids.get(word)
        if found is None:
            found = self.ids[word] = len(self.words)
            self.words.append(word)
        return found

    def add(self, lang: str, phrase: bytes, n: int) -> None:
        """Count a phrase, its words joined by one blank, ``n`` times more."""
        node = self.roots.get(lang)
        if node is None:
            node = self.roots[lang] = Node()
        while True:
            head, _, phrase = phrase.partition(b" ")
            word = self.id(head)
            below = node.children.get(word)
            if below is None:
                node.children[word] = {phrase: n} if phrase else n
                self.size += 1
            elif isinstance(below, Node):
                if phrase:
                    node = below
                    continue
                self.size += not below.here
                below.here += n
            elif isinstance(below, dict):
                self.size += phrase not in below
                below[phrase] = below.get(phrase, 0) + n
                if len(below) > self.burst:
                    node.children[word] = self.split(below)
            elif phrase:  # a phrase that goes on where another ends
                node.children[word] = {b"": below, phrase: n}
                self.size += 1
            else:
                node.children[word] = below + n
            return

    def split(self, container: dict[bytes, int]) -> Node:
        node = Node(container.get(b"", 0))
        for rest, n in container.items():
            if rest:
                head, _, tail = rest.partition(b" ")
                word = self.id(head)
                below = node.children.get(word)
                if below is None:
                    node.children[word] = {tail: n} if tail else n
                elif isinstance(below, dict):
                    below[tail] = n
                else:
                    node.children[word] = {b"": below, tail: n}
        return node

    def under(self, below: Below, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        if isinstance(below, int):
            yield prefix, below
        elif isinstance(below, dict):
            for rest, n in below.items():
                yield (prefix + b" " + rest if rest else prefix), n
        else:
            if below.here:
                yield prefix, below.here
            for word, child in below.children.items():
                yield from self.under(child, prefix + b" " + self.words[word])

    def entries(self, below: Below) -> int:
        if isinstance(below, Node):
            return (below.here > 0) + sum(map(self.entries, below.children.values()))
        return 1 if isinstance(below, int) else len(below)

    def spill(self, keep: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        """Take out the largest subtrees until ``keep`` entries are left: a sorted run each."""
        subtrees = [(self.entries(below), lang, word) for lang, root in self.roots.items() for word, below in root.children.items()]
        if keep:
            subtrees.sort(key=lambda s: -s[0])
        for size, lang, word in subtrees:
            if self.size <= keep:
                break
            yield lang, sorted(self.under(self.roots[lang].children.pop(word), self.words[word]))
            self.size -= size
        if not keep:
            self.empty()


class Runs:
    """What a task counts: the newest phrases of a language in a container above its trie, which spills."""

    def __init__(self, burst: int = BURST, most: int = MOST) -> None:
        self.trie, self.most = PhraseTrie(burst, most), most
        self.waiting: dict[str, Counter[bytes]] = {}

    def add(self, lang: str, phrases: Iterable[bytes]) -> None:
        self.waiting.setdefault(lang, Counter()).update(phrases)

    def settle(self, least: int = WAITING) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        """Bring containers of more than ``least`` phrases into the trie; it spills half when it is full."""
        for lang, counts in self.waiting.items():
            if len(counts) > least:
                for phrase, n in counts.items():
                    self.trie.add(lang, phrase, n)
                counts.clear()
                if self.trie.size > self.most:
                    # Words are forgotten with the last phrase only.
                    yield from self.trie.spill(self.most // 2 if len(self.trie.words) < 2 * self.most else 0)

    def end(self) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        yield from self.settle(0)
        yield from self.trie.spill(0)


def run_rows(runs: Iterator[tuple[str, list[tuple[bytes, int]]]]) -> Iterator[pa.RecordBatch]:
    langs, phrases, counts = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

    for lang, run in runs:
        langs.extend([lang] * len(run))
        phrases.extend(p for p, _ in run)
        counts.extend(n for _, n in run)
        if len(langs) > 20_000:
            yield batch()
            langs, phrases, counts = [], [], []
    if langs:
        yield batch()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Folded texts of a language, some ``SLICE`` bytes at a time (one text may be longer)."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter[str] = Counter()
    for batch in batches:
        for lang, body in zip(batch["lang"], batch["body"], strict=True):
            lang = lang.as_py()
            held.setdefault(lang, []).append(body.as_py())
            sizes[lang] += len(held[lang][-1])
            if sizes[lang] >= SLICE:
                yield lang, MARK.join(held.pop(lang)).translate(FOLD)
                del sizes[lang]
    for lang, bodies in held.items():
        yield lang, MARK.join(bodies).translate(FOLD)


def text_size(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0


def in_few_tasks(texts: DataFrame, size: int) -> DataFrame:
    """``size`` bytes of texts in a task per core, in more if a task had over ``TASK`` bytes."""
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))


def run_table(texts: DataFrame, k: int, burst: int = BURST, most: int = MOST, bits: np.ndarray | None = None) -> DataFrame:
    """Sorted runs (lang, phrase, n) of the phrases of ``k`` words in each task; ``texts`` has lang and body.

    With ``bits`` (see ``gram_filter``) only the phrases of full buckets.
    """
    held = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(burst, most)
        buckets = None if held is None else Buckets(1, len(held.value) * 8)
        for lang, folded in slices(batches):
            if buckets:
                tokens, starts, at = buckets.grams(lang, folded, k)
                runs.add(lang, (b" ".join(tokens[i:i + k]) for i in starts[is_set(held.value, at)].tolist()))
            else:
                for piece in folded.split(MARK):
                    words = piece.split()
                    if len(words) >= k:
                        runs.add(lang, map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
            yield from run_rows(runs.settle())
        yield from run_rows(runs.end())
        common.give_back()

    return materialize(texts.select("lang", "body").mapInArrow(run, "lang string, phrase binary, n long"))


class Buckets:
    """Places of words, pairs and longer phrases in buckets, by hashes of the words and the language."""

    def __init__(self, words: int, pairs: int) -> None:
        self.words, self.pairs = np.uint64(words - 1), np.uint64(pairs - 1)
        self.hashes = common.WordHashes()
        self.mark = np.uint64(xxhash.xxh3_64_intdigest(MARK))

    def hashed(self, lang: str, folded: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.uint64]:
        tokens = folded.replace(MARK, b" " + MARK + b" ").split()
        hashes = self.hashes.of(tokens)
        return tokens, hashes, hashes != self.mark, np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))

    def grams(self, lang: str, folded: bytes, k: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words and marks in order, where phrases of ``k`` words start, and the bucket of each of these."""
        tokens, hashes, is_word, salt = self.hashed(lang, folded)
        n = max(0, len(tokens) - k + 1)
        whole = is_word[:n].copy()
        with np.errstate(over="ignore"):
            total = hashes[:n] + salt
            for i in range(1, k):
                whole &= is_word[i:n + i]
                total = total * common.GOLDEN + hashes[i:n + i]
        starts = np.flatnonzero(whole)
        return tokens, starts, common.mixed(total[starts]) & self.pairs

    def of(self, lang: str, folded: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words and marks in order, which are words, bucket of each, bucket of each with the next one."""
        tokens, hashes, is_word, salt = self.hashed(lang, folded)
        with np.errstate(over="ignore"):
            single = common.mixed(hashes + salt) & self.words
            double = common.mixed((hashes[:-1] + salt) * common.GOLDEN + hashes[1:]) & self.pairs
        return tokens, is_word, single, double


COUNTED = "kind int, block int, lang string, n long, counts binary"


def counted_row(kind: int, block: int, lang: str | None = None, n: int | None = None, counts: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([counts], pa.binary()),
    ], ["kind", "block", "lang", "n", "counts"])


def count_in(counts: np.ndarray, found: np.ndarray) -> None:
    # Counts stop at 255; a bucket that full in one task counts as full.
    at, n = np.unique(found, return_counts=True)
    counts[at] = np.minimum(counts[at] + n, 255)


def count_blocks(kind: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    grid = counts.reshape(-1, min(BLOCK, len(counts)))
    for at in np.flatnonzero(grid.any(axis=1)).tolist():
        yield counted_row(kind, at, counts=grid[at].tobytes())


def full_blocks(counted: DataFrame, least: int) -> DataFrame:
    """Bits (kind, block, bits) of the buckets that hold ``least``, over the counts of all tasks."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = over = kind = block = None
        for batch in batches:
            kind, block = batch["kind"][0].as_py(), batch["block"][0].as_py()
            for raw in batch["counts"]:
                part = np.frombuffer(raw.as_buffer(), np.uint8)
                total = part.astype(np.int64) if total is None else total + part
                over = part == 255 if over is None else over | (part == 255)
        if total is not None:
            bits = np.packbits((total >= least) | over, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int32()), pa.array([bits.tobytes()])], ["kind", "block", "bits"])

    return materialize(counted.filter("kind < 2").groupBy("kind", "block").applyInArrow(full, "kind int, block int, bits binary"))


def block_bits(blocks: DataFrame, kind: int, size: int) -> np.ndarray:
    return bloom.from_blocks(blocks.filter(F.col("kind") == kind), size // 64, "bits").view(np.uint8)


def bucket_filters(texts: DataFrame, words: int, pairs: int, least: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Bits of the buckets that hold ``least`` words, or pairs, over all texts; words per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, totals = Buckets(words, pairs), Counter()
        counts = [np.zeros(words, np.uint8), np.zeros(pairs, np.uint8)]
        for lang, folded in slices(batches):
            tokens, is_word, single, double = buckets.of(lang, folded)
            totals[lang] += int(is_word.sum())
            count_in(counts[0], single[is_word])
            count_in(counts[1], double[is_word[:-1] & is_word[1:]])
        for lang, n in totals.items():
            yield counted_row(2, 0, lang, n)
        for kind, held in enumerate(counts):
            yield from count_blocks(kind, held)
        del counts[:]
        common.give_back()

    counted = materialize(texts.select("lang", "body").mapInArrow(count, COUNTED))
    totals = materialize(counted.filter("kind = 2").groupBy("lang").agg(F.sum("n").alias("words")))
    blocks = full_blocks(counted, least)
    return block_bits(blocks, 0, words), block_bits(blocks, 1, pairs), totals


def gram_filter(texts: DataFrame, k: int, size: int, least: int) -> np.ndarray:
    """Bits of the buckets, ``size`` in all, that hold ``least`` phrases of ``k`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, counts = Buckets(1, size), np.zeros(size, np.uint8)
        for lang, folded in slices(batches):
            count_in(counts, buckets.grams(lang, folded, k)[2])
        yield from count_blocks(1, counts)
        del counts
        common.give_back()

    return block_bits(full_blocks(materialize(texts.select("lang", "body").mapInArrow(count, COUNTED)), least), 1, size)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def candidates(texts: DataFrame, word_bits: np.ndarray, pair_bits: np.ndarray) -> DataFrame:
    """Runs of the words of full buckets (lang, phrase, n), and stretches of pairs of full buckets (lang, body)."""
    words, pairs = len(word_bits) * 8, len(pair_bits) * 8
    held = texts.sparkSession.sparkContext.broadcast((word_bits, pair_bits))
    names = ["lang", "phrase", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, buckets = Runs(), Buckets(words, pairs)
        single_bits, double_bits = held.value

        def counted(found: Iterator[tuple[str, list[tuple[bytes, int]]]]) -> Iterator[pa.RecordBatch]:
            for batch in run_rows(found):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(len(batch), pa.binary())], names)

        for lang, folded in slices(batches):
            tokens, good, single, double = buckets.of(lang, folded)
            good &= is_set(single_bits, single)
            runs.add(lang, compress(tokens, good.tolist()))
            yield from counted(runs.settle())
            both = good[:-1] & good[1:] & is_set(double_bits, double)
            edges = np.flatnonzero(np.diff(np.r_[0, both.astype(np.int8), 0])).tolist()
            if edges:
                body = b"\n".join(b" ".join(tokens[a:b + 1]) for a, b in zip(edges[::2], edges[1::2], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([body], pa.binary())], names)
        yield from counted(runs.end())
        common.give_back()

    return materialize(texts.select("lang", "body").mapInArrow(run, "lang string, phrase binary, n long, body binary"))


def merged(runs: DataFrame) -> DataFrame:
    """Exact counts: runs meet in ranges of (language, phrase)."""
    return runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def key_hash(lang: str, phrases: list[bytes]) -> np.ndarray:
    head = (lang + "\n").encode("utf-8", "surrogatepass")
    return np.fromiter((xxhash.xxh3_64_intdigest(head + p) for p in phrases), np.uint64, len(phrases))


def phrase_filter(frequent: DataFrame) -> np.ndarray:
    """Bloom filter of the phrases, joined from one filter per task."""
    words = bloom.size_for(frequent.count(), BITS_A_PHRASE, LEAST_BITS, MOST_BITS)
    block_words = min(words, 2**11)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                bloom.add(bits, key_hash(lang, phrases))
        grid = bits.reshape(-1, block_words)
        used = np.flatnonzero(grid.any(axis=1))
        for at in range(0, len(used), 64):
            part = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([grid[i].tobytes() for i in part], pa.binary())], ["block", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, block = np.zeros(block_words, np.uint64), None
        for batch in batches:
            block = batch["block"][0].as_py()
            for raw in batch["bits"]:
                bits |= np.frombuffer(raw.as_buffer(), "<u8")
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()])], ["block", "bits"])

    schema = "block int, bits binary"
    return bloom.from_blocks(frequent.mapInArrow(run, schema).groupBy("block").applyInArrow(joined, schema), words, "bits")


def stretches(good: list[bool], k: int) -> Iterator[tuple[int, int]]:
    """Word intervals of at least ``k`` + 1 words whose phrases of ``k`` words are all good."""
    start = None
    for i, fine in enumerate([*good, False]):
        if fine and start is None:
            start = i
        elif not fine and start is not None:
            if i - start > 1:
                yield start, i + k - 1
            start = None


def shrunk(texts: DataFrame, k: int, bits: np.ndarray) -> DataFrame:
    """Texts cut down to stretches of which every phrase of ``k`` words is in the filter."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, bool]] = {}
        for batch in batches:
            langs, bodies = [], []
            for lang, body in zip(batch["lang"].to_pylist(), batch["body"], strict=True):
                fine = known.setdefault(lang, {})
                pieces = [w for piece in body.as_py().translate(FOLD).split(MARK) if len(w := piece.split()) > k]
                grams = [list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))) for w in pieces]
                new = list(set().union(*grams).difference(fine)) if grams else []
                if len(fine) > MOST:
                    fine.clear()
                    new = list(set().union(*grams))
                if new:
                    fine.update(zip(new, bloom.holds(held.value, key_hash(lang, new)).tolist(), strict=True))
                kept = []
                for words, own in zip(pieces, grams, strict=True):
                    good = list(map(fine.__getitem__, own))
                    if all(good):
                        kept.append(b" ".join(words))
                    elif any(good):
                        kept.extend(b" ".join(words[a:b]) for a, b in stretches(good, k))
                if kept:
                    langs.append(lang)
                    bodies.append(b"\n".join(kept))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bodies, pa.binary())], ["lang", "body"])
        known.clear()
        common.give_back()

    return materialize(texts.select("lang", "body").mapInArrow(run, "lang string, body binary"))


def bucket_count(size: int) -> int:
    """Buckets for the pairs, or longer phrases, of ``size`` bytes."""
    return 64 * bloom.size_for(size // 14, 1, LEAST_BUCKETS, MOST_BUCKETS)


def frequent_phrases(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to ``longest`` words found ``least`` times (lang, phrase, k, n); words per lang."""
    size = text_size(texts)
    texts = in_few_tasks(texts, size)
    # A pair in seven bytes, two of them to a bucket; fewer different words.
    pairs = bucket_count(size)
    word_bits, pair_bits, totals = bucket_filters(texts, max(LEAST_BUCKETS, pairs // 4), pairs, least)
    found = []
    for k in range(1, longest + 1):
        if k == 1:
            both = candidates(texts, word_bits, pair_bits)
            runs, texts = both.filter("phrase IS NOT NULL").select("lang", "phrase", "n"), both.filter("body IS NOT NULL").select("lang", "body")
        else:
            size = text_size(texts)
            texts = in_few_tasks(texts, size)
            # The pairs of the stretches are all in full buckets.
            runs = run_table(texts, k, bits=gram_filter(texts, k, bucket_count(size), least) if k > 2 else None)
        often = materialize(merged(runs).filter(F.col("n") >= least))
        found.append(often.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "n"))
        if 1 < k < longest:
            texts = shrunk(texts, k, phrase_filter(often))
    return materialize(common.union_all(found)), totals


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """The ``top`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    Words stand between blanks and tabs of pieces, which end at ``.,;:!?`` and line ends;
    A to Z are lower-cased. A phrase of 2 to ``longest`` words found ``least`` times is a
    candidate; its score is the least, over all cuts into a first part and a rest, of
    floor(1000 a n / (l r)), the shortest first part winning ties. Candidates that stand
    inside a longer one with at least ``share`` percent of their count are dropped. Equal
    scores go by count, then by phrase. A null language is ``und``; a null text is empty; a
    very long text is read whole, in one task; repeated rows count each; an empty table
    gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = common.only(docs, lang=F.coalesce(F.col(lang), F.lit(NO_LANG)), body=body)
    counts, totals = frequent_phrases(texts, longest, least)
    words = F.split("phrase", " ")
    cuts = counts.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    parts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("rest"))
    first = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(words AS DECIMAL(17,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = parts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang").select("lang", "phrase", "a", "cut", "l", "r", "words", score.alias("score"))
    best = scored.groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    # All shorter phrases (of two words or more) inside a candidate, with its count.
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    sized = counts.filter("k > 2").select("lang", "k", F.col("n").alias("longer"), words.alias("w"), size)
    inner = sized.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    held = inner.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("longer").alias("longer"))
    free = best.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = free.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", F.col("words").alias("n"), "b.score")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(common.read(spark, folder, "documents"))


SQL = {"op13_phrases": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
words AS (
  SELECT id, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT id, lang, w, unnest(range(1, len(w) + 1)) AS p FROM words),
grams AS (
  SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE p + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM counts WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, f.n AS l, r.n AS r, t.n,
    (1000::HUGEINT * c.a * t.n // (f.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
free AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.lang = b.lang AND c.n >= b.a AND len(c.phrase) > len(b.phrase)
      AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY rank <= 2000
"""}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_phrases": op13_phrases}
