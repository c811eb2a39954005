"""Near duplicates by n-gram Jaccard similarity: a MinHash LSH forest, then exact verification.

1. Signatures: every distinct text has one label per tree, ``depth`` minimum hashes in
   order. A tree is the sorted trie of its labels.
2. A trie is cut into leaves. Matched prefixes are shortened, from the full label, to the
   longest length at which a pair at the threshold meets in some tree with the target
   recall; where few texts share a prefix they are shortened further, to ``shortest``, which
   raises the recall at little cost. A prefix that more than ``dense`` texts share keeps its
   branches, so crowded parts of a trie stay finely divided.
3. The smallest text of a leaf is its hub. A text belongs to the hubs of its leaves, one a
   tree at most; so it is copied at most as often as there are trees, whatever its
   neighbours meet. A hub that meets a smaller one in ``CLOSE`` trees, as near duplicates do
   and other texts rarely, hands its texts over to it, ``HOPS`` times at most: no chains of
   unverified meetings are followed to their end.
4. The texts of a hub are a group. One of more than ``block`` texts or ``block_bytes`` bytes
   is dealt into blocks, and each pair of blocks is one task. A pair is verified on whole
   shingle sets, in the smallest of the hubs both belong to. Pairs never become rows: a task
   returns, per text, its number of links and one link to the smallest text it is tied to.
5. Classes are the connected components of verified links. Copies of a text are one
   text throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common
from casewatch.llm.components import components
from casewatch.session import materialize

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.995
SHORTEST, DENSE = 5, 64
BLOCK, BLOCK_BYTES = 512, 2**23
#: Bytes of a group after which a worker gives its memory back; most groups are a few texts.
LARGE = 2**21
#: Trees two hubs share leaves in before one stands for the other, and how often that is done.
CLOSE, HOPS = 3, 2
#: Bits of a label kept of each minimum hash after the shortest prefix.
STEP = 16


def prefix_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """Longest prefix at which a pair at the threshold meets often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str | None, words: int, hashes: common.WordHashes) -> np.ndarray:
    return common.grams(hashes.of(common.encoded(text).split()), words)


class Labels:
    """Per tree, a hash of the shortest prefix, and the minimum hashes after it, 16 bits each, first ones highest."""

    def __init__(self, trees: int, depth: int, shortest: int) -> None:
        rng = np.random.default_rng(7)
        self.factor = rng.integers(1, 2**63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, trees * depth, np.uint64)
        self.shape, self.shortest = (trees, depth), shortest

    def of(self, grams: np.ndarray, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        least = np.full(len(self.factor), 2**64 - 1, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), chunk):
                values = self.factor[:, None] * grams[None, at:at + chunk]
                values += self.shift[:, None]
                np.minimum(least, values.min(axis=1), out=least)
            prefix, rest = np.zeros(self.shape[0], np.uint64), np.zeros(self.shape[0], np.uint64)
            for i, value in enumerate(least.reshape(self.shape).T):
                if i < self.shortest:
                    prefix = (prefix + common.mixed(value)) * common.GOLDEN
                else:
                    rest = (rest << np.uint64(STEP)) | (common.mixed(value) >> np.uint64(64 - STEP))
        return common.mixed(prefix), rest


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, trees: int, depth: int, shortest: int) -> DataFrame:
    """One narrow row per document: identifier, content key, bytes and labels; computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, labels = common.WordHashes(), Labels(trees, depth, shortest)
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found, sizes = [], []
                for t in part["text"]:
                    body = t.as_py()
                    grams = shingles(body, words, hashes)
                    found.append([x.view(np.int64) for x in labels.of(grams)] if len(grams) else (None, None))
                    sizes.append(len(body))
                made = [pa.array([f[i] for f in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sizes, pa.int64()), *made], ["doc_id", "k", "size", "prefixes", "rests"])
        hashes.clear()
        common.give_back()

    body = F.coalesce(F.col(text), F.lit(""))
    narrow = common.only(docs, doc_id=F.col(doc_id).cast("long"), k=common.text_key(F.col(doc_id), body), text=body)
    made = narrow.mapInArrow(run, "doc_id long, k struct<id: long, h1: long, h2: long>, size long, prefixes array<bigint>, rests array<bigint>")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()))


def memberships(labels: DataFrame, steps: int, deeper: int, dense: int) -> DataFrame:
    """The hubs of the leaves a node is in, if the leaf holds another node: node, hub, trees.

    ``labels`` has node, tree, prefix and rest, which holds ``steps`` minimum hashes. Below
    prefixes of more than ``dense`` nodes, branches are followed for up to ``deeper`` steps.
    """
    open_, parts = labels.withColumn("branch", F.lit(0).cast("long")), []
    for step in range(deeper + 1):
        key = ["tree", "prefix", "branch"]
        # A table, not an aggregate: then the join may split a crowded prefix.
        groups = materialize(open_.groupBy(*key).agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
        leaf = F.lit(True) if step == deeper else F.col("n") <= dense
        parts.append(open_.join(groups.filter(leaf).select(*key, "hub"), key).groupBy("node", "hub").agg(F.count("*").alias("trees")))
        if step < deeper:
            crowded = open_.join(groups.filter(~leaf).select(*key), key, "left_semi")
            # The next minimum hash of the label joins the path.
            open_ = materialize(crowded.withColumn("branch", F.shiftrightunsigned("rest", STEP * (steps - 1 - step))))
    return common.union_all(parts).groupBy("node", "hub").agg(F.sum("trees").alias("trees"))


def handed_over(held: DataFrame, close: int, hops: int) -> DataFrame:
    """Memberships after close hubs have handed their texts to smaller ones.

    All texts of a hub go the same way, so a pair that shares a hub still shares one.
    """
    for _ in range(hops):
        held = materialize(held)
        heirs = held.filter((F.col("hub") < F.col("node")) & (F.col("trees") >= close)).groupBy("node").agg(F.min("hub").alias("heir"))
        joined = held.join(materialize(heirs.select(F.col("node").alias("hub"), "heir")), "hub", "left")
        held = joined.groupBy("node", F.coalesce("heir", "hub").alias("hub")).agg(F.sum("trees").alias("trees"))
    return held


def verify(words: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links inside one block of a hub, or between two, of pairs that no smaller hub holds."""

    def run(table: pa.Table) -> pa.Table:
        part = table.select(["node", "block", "hubs"]).to_pydict()
        once = {n: i for i, n in enumerate(part["node"])}
        rows = sorted(once.values(), key=lambda i: (part["block"][i], part["node"][i]))
        hashes = common.WordHashes()
        sets = [np.unique(shingles(table["text"][i].as_py(), words, hashes)) for i in rows]
        hashes.clear()
        sizes = np.array([len(s) for s in sets])
        ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        hub, low, high = (table[c][0].as_py() for c in ("hub", "i", "j"))
        # Smaller hubs of each text: a pair that shares one is verified there.
        smaller = [frozenset(h for h in part["hubs"][i] if h < hub) for i in rows]
        kinds = {s: n for n, s in enumerate(dict.fromkeys(smaller))}
        kind = np.array([kinds[s] for s in smaller])
        apart = np.array([[s.isdisjoint(t) for t in kinds] for s in kinds])
        block = np.array([part["block"][i] for i in rows])
        present = np.zeros(max((int(x.max()) for x in ids), default=0) + 1, bool)
        links, root_of = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def root(x: int) -> int:
            while root_of[x] != x:
                root_of[x] = x = root_of[root_of[x]]
            return x

        for a in range(len(rows)):
            if low != high and block[a] != low:
                break
            others = np.arange(a + 1, len(rows)) if low == high else np.flatnonzero(block == high)
            fits = np.minimum(sizes[others], sizes[a]) >= threshold * np.maximum(sizes[others], sizes[a]) - 1e-9
            others = others[fits & apart[kind[a], kind[others]]]
            if not len(others):
                continue
            present[ids[a]] = True
            ends = np.cumsum(sizes[others])
            common_ = np.add.reduceat(present[np.concatenate([ids[b] for b in others])], np.r_[0, ends[:-1]], dtype=np.int64)
            present[ids[a]] = False
            tied = others[common_ >= threshold * (sizes[others] + sizes[a] - common_) - 1e-9]
            links[a] += len(tied)
            links[tied] += 1
            for b in tied:
                x, y = root(a), root(b)
                root_of[max(x, y)] = min(x, y)
        nodes = [part["node"][i] for i in rows]
        made = pa.table({"node": nodes, "links": links, "tied_to": [nodes[root(a)] for a in range(len(rows))]})
        if table.nbytes > LARGE:
            del sets, ids, present
            common.give_back()
        return made

    return run


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES,
    depth: int = DEPTH, recall: float = RECALL, shortest: int = SHORTEST, dense: int = DENSE, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: class, class size, copies of its text, links to other texts.

    ``class_id`` is the largest identifier of the class; documents with equal text are
    in one class. A text under ``words`` words is one shingle; a null or empty text has
    none and is linked to its equals alone. A null identifier is the smallest. A very long
    text is read whole and fills blocks of its own. An empty table gives no rows; other
    columns are not read.
    """
    longest = prefix_depth(trees, depth, threshold, recall)
    shortest = min(shortest, longest)
    rows = signatures(docs, doc_id, text, words, trees, depth, shortest)
    texts = rows.groupBy("k.h1", "k.h2").agg(F.max("row").alias("node"), F.count("*").alias("n_copies"))
    nodes = rows.join(texts.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "k", "size", "prefixes", "rests")
    met = nodes.select("node", F.posexplode(F.arrays_zip("prefixes", "rests")).alias("tree", "label")).select("node", "tree", "label.prefixes", "label.rests")
    labels = materialize(met.toDF("node", "tree", "prefix", "rest"))
    held = materialize(handed_over(memberships(labels, depth - shortest, longest - shortest, dense), CLOSE, HOPS))
    # A text that is near none but itself in a leaf has no row here.
    hubs = held.groupBy("node").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    wanted = materialize(nodes.select("node", "k", "size").join(hubs, "node"))
    each = wanted.select("node", "size", F.explode("hubs").alias("hub"))
    parts = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_bytes)).cast("int")
    blocks = materialize(each.groupBy("hub").agg(parts.alias("blocks")))
    dealt = each.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    places = materialize(dealt.groupBy("node").agg(F.collect_list(F.struct("hub", "block", "blocks")).alias("places")))
    body = F.coalesce(F.col(text), F.lit(""))
    whole = common.only(docs, k=common.text_key(F.col(doc_id), body), text=body)
    # Documents that repeat identifier and text share a key: tasks take one of them.
    read = whole.join(wanted.select("k", "node", "hubs").join(places, "node"), "k")
    spread = read.select("node", "hubs", "text", F.explode("places").alias("p")).select("node", "hubs", "text", "p.*").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "hubs", "text")
    links = materialize(spread.groupBy("hub", "i", "j").applyInArrow(verify(words, threshold), "node long, links long, tied_to long"))
    classes = components(links.filter("node <> tied_to").select(F.col("node").alias("u"), F.col("tied_to").alias("v")))
    per_text = (
        texts.join(links.groupBy("node").agg(F.sum("links").alias("n_links")), "node", "left").join(classes, "node", "left")
        .withColumn("class", F.coalesce("root", "node"))
    )
    every = materialize(rows.select("doc_id", "k").alias("r").join(per_text, F.expr("r.k.h1 = h1 AND r.k.h2 = h2")).select(
        "doc_id", "k", "class", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    of_class = materialize(every.groupBy("class").agg(F.max("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return every.join(of_class, "class").select("doc_id", "class_id", "class_size", "n_copies", "n_links", "k", "class")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: float) -> DataFrame:
    """One document of each class, the one with the largest identifier; same columns."""
    found = near_duplicates(docs, doc_id, text, **options)
    kept = found.groupBy("class").agg(F.max("k").alias("k")).select("k")
    k = common.text_key(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct("*").alias("r"), k.alias("k")).join(kept, "k", "left_semi")
    one = rows.groupBy("k").agg(F.first("r").alias("r"))  # rows that repeat identifier and text
    return one.select(*[F.col(f"r.`{c}`") for c in docs.columns])


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(common.read(spark, folder, "documents")).drop("k", "class")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_ngram_jaccard": op9_ngram_jaccard}
