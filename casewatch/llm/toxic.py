"""Toxic spans by a linear-chain conditional random field, and document scores from them.

Token labels. A word is marked where it is held by far more toxic than clean training
documents (``RATIO`` times, and by ``SUPPORT`` of the toxic ones); its tokens in toxic
documents are labelled toxic, all other tokens clean.

Field. Two states; features are the word, its first and last three bytes, and the
words before and after, hashed into ``2**BITS`` weights. It is fitted by gradient
steps on at most ``SAMPLE`` labelled rows of each class: the only bounded part.

Scores. Forward-backward marginals of every token of every whole text. Their maximum,
and the expected number of toxic tokens, go through a logistic curve fitted on the
same rows with the class shares of all training labels. Spans are runs of tokens whose
marginal is at least one half.

Messages run over one stream of all texts of a batch, cut into equal lanes: first the
product of each lane, then lane to lane, then inside all lanes at once. A text's first
token resets the chain.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain as chained
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import common

SAMPLE, BITS = 1500, 18
#: Bytes of text scored together.
SLICE = 2**20
RATIO, SUPPORT = 8.0, 0.02
EPOCHS, STEP, DECAY, BATCH = 6, 0.5, 1e-6, 64
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"
SPAN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Model(NamedTuple):
    """Weights by hashed feature, transitions, first-token odds, logistic curve."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    curve: np.ndarray


def normal(word: bytes) -> bytes:
    return word.strip(EDGES).lower()


class Features(dict):
    """Slots of a word: itself, first and last bytes, as the one before, as the one after."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit
        self.slots, self.fresh = np.zeros((0, 5), np.int64), []

    def __missing__(self, raw: bytes) -> int:
        word = normal(raw)
        slot = [xxhash.xxh3_64_intdigest(x, seed) & (2**BITS - 1)
                for seed, x in enumerate((word, word[:3], word[-3:], word, word))]
        self[raw] = at = len(self.slots) + len(self.fresh)
        self.fresh.append(slot)
        return at

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words' slots, the word number of every token, tokens per text."""
        if len(self) > self.limit:
            self.clear()
            self.slots, self.fresh = np.zeros((0, 5), np.int64), []
        words = [common.encoded(t).split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter(map(self.__getitem__, chained.from_iterable(words)), np.int64, int(sizes.sum()))
        if self.fresh:
            self.slots, self.fresh = np.concatenate([self.slots, np.array(self.fresh, np.int64)]), []
        return self.slots, ids, sizes


@cache
def worker_features() -> Features:
    """One per Python worker, kept for its later tasks: slots do not depend on a model."""
    return Features()


def emissions(model: Model, slots: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of toxic at every token, neighbours of the same text included."""
    met, ids = np.unique(ids, return_inverse=True)
    by_word = model.weights[slots[met]]
    out = model.bias + by_word[:, :3].sum(axis=1)[ids]
    if len(ids) > 1:
        inner = ~first[1:]
        out[1:] += by_word[ids[:-1], 3] * inner
        out[:-1] += by_word[ids[1:], 4] * inner
    return np.clip(out, -30, 30)


def chain(odds: np.ndarray, first: np.ndarray, transitions: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal of toxic per token, and expected transitions (2 by 2, first tokens left out)."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    steps = max(1, int(np.sqrt(n)))
    lanes = -(-n // steps)
    x = np.ones(lanes * steps)
    x[:n] = np.exp(odds)
    reset = np.ones(lanes * steps, bool)
    reset[:n] = first
    a = np.exp(transitions)
    lane = lambda v: np.ascontiguousarray(v.reshape(lanes, steps).T)
    t = [[lane(np.where(reset, 1.0, a[0, 0])), lane(np.where(reset, 1.0, a[0, 1]) * x)],
         [lane(np.where(reset, 1.0, a[1, 0])), lane(np.where(reset, 1.0, a[1, 1]) * x)]]
    product = [[np.ones(lanes), np.zeros(lanes)], [np.zeros(lanes), np.ones(lanes)]]
    for k in range(steps):
        product = [[p[0] * t[0][j][k] + p[1] * t[1][j][k] for j in (0, 1)] for p in product]
        total = product[0][0] + product[0][1] + product[1][0] + product[1][1]
        product = [[v / total for v in p] for p in product]
    whole = np.array(product).transpose(2, 0, 1)
    ahead, behind = np.empty((lanes, 2)), np.empty((lanes, 2))
    state = np.array([0.5, 0.5])
    for b in range(lanes):
        ahead[b] = state
        state = state @ whole[b]
        state /= state.sum()
    state = np.array([0.5, 0.5])
    for b in range(lanes - 1, -1, -1):
        behind[b] = state
        state = whole[b] @ state
        state /= state.sum()
    alpha, beta = np.empty((2, steps, lanes)), np.empty((2, steps, lanes))
    v = ahead.T.copy()
    for k in range(steps):
        v = np.array([v[0] * t[0][j][k] + v[1] * t[1][j][k] for j in (0, 1)])
        v /= v.sum(axis=0)
        alpha[:, k] = v
    v = behind.T.copy()
    for k in range(steps - 1, -1, -1):
        beta[:, k] = v
        v = np.array([v[0] * t[i][0][k] + v[1] * t[i][1][k] for i in (0, 1)])
        v /= v.sum(axis=0)
    both = (alpha * beta).transpose(0, 2, 1).reshape(2, -1)[:, :n]
    marginal = both[1] / both.sum(axis=0)
    if not pairs:
        return marginal, None
    flat_a, flat_b = alpha.transpose(0, 2, 1).reshape(2, -1)[:, :n], beta.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    pair = flat_a[:, None, :-1] * a[:, :, None] * np.array([np.ones(max(n - 1, 0)), x[1:n]])[None] * flat_b[None, :, 1:]
    pair = pair / pair.sum(axis=(0, 1)) * ~first[1:]
    return marginal, pair.sum(axis=2)


def firsts(sizes: np.ndarray) -> np.ndarray:
    """Marks of the first token of each text."""
    out = np.zeros(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    out[starts[sizes > 0]] = True
    return out


def lexicon(texts: list[str], toxic: np.ndarray, ratio: float, support: float) -> set[bytes]:
    """Words that far more toxic than clean documents hold."""
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        held[int(label)].update({normal(w) for w in common.encoded(text).split()})
    bad, good = int(toxic.sum()), int((1 - toxic).sum())
    least = max(3, support * bad)
    return {w for w, n in held[1].items() if w and n >= least and n / (bad + 1) > ratio * (held[0][w] + 0.5) / (good + 1)}


def fit(texts: list[str], toxic: np.ndarray, share: float, ratio: float = RATIO, support: float = SUPPORT) -> Model:
    """Field and curve from labelled texts; ``share`` is the share of toxic among all training labels."""
    weights, bias, moves = np.zeros(2**BITS), np.array([-3.0]), np.zeros((2, 2))
    model = Model(weights, -3.0, moves, np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, 0.0]))
    if not 0 < toxic.sum() < len(toxic):
        return model
    marked = lexicon(texts, toxic, ratio, support)
    features = Features(10**9)
    order = np.random.default_rng(11).permutation(len(texts))
    batches = [(order[i:i + BATCH], *features.of([texts[j] for j in order[i:i + BATCH]])[1:]) for i in range(0, len(order), BATCH)]
    slots = features.slots
    is_marked = np.zeros(len(slots), bool)
    is_marked[[i for w, i in features.items() if normal(w) in marked]] = True
    seen = [np.full_like(v, 1e-3) for v in (weights, bias, moves)]
    for _ in range(EPOCHS):
        for chosen, ids, sizes in batches:
            if not len(ids):
                continue
            first = firsts(sizes)
            label = is_marked[ids] & np.repeat(toxic[chosen] == 1, sizes)
            now = Model(weights, float(bias[0]), moves, model.curve)
            p, pairs = chain(emissions(now, slots, ids, first), first, moves)
            miss = (p - label) / len(chosen)
            own = slots[ids]
            inner = ~first[1:]
            places = np.concatenate([own[:, 0], own[:, 1], own[:, 2], own[:-1, 3][inner], own[1:, 4][inner]])
            values = np.concatenate([miss, miss, miss, miss[1:][inner], miss[:-1][inner]])
            step_w = np.bincount(places, values, len(weights)) + DECAY * weights
            met = np.zeros((2, 2))
            np.add.at(met, (label[:-1][inner].astype(int), label[1:][inner].astype(int)), 1)
            for value, grad, past in ((weights, step_w, seen[0]), (bias, np.array([miss.sum()]), seen[1]), (moves, (pairs - met) / len(chosen), seen[2])):
                past += grad**2
                value -= STEP * grad / np.sqrt(past)
    model = Model(weights.astype(np.float32), float(bias[0]), moves, model.curve)
    summary = np.concatenate([summaries(model, features, texts[i:i + 256])[0] for i in range(0, len(texts), 256)])
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return model._replace(curve=logistic(summary, toxic, weight))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; intercept first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag(np.r_[1e-6, np.ones(x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -5, 5)
    return w


def summaries(model: Model, features: Features, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: log odds of its largest marginal and log of expected toxic tokens; marginals; sizes."""
    slots, ids, sizes = features.of(texts)
    first = firsts(sizes)
    p, _ = chain(emissions(model, slots, ids, first), first, model.transitions, pairs=False)
    out = np.zeros((len(texts), 2))
    out[:, 0] = -8.0
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        top = np.maximum.reduceat(p, starts)
        out[some, 0] = np.clip(np.log(top + 1e-12) - np.log1p(-np.minimum(top, 1 - 1e-9)), -8, 8)
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0.0), starts))
    return out, p, sizes


def scores_of(model: Model, summary: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.curve[0] + summary @ model.curve[1:], -30, 30)))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Code point offsets of runs of toxic tokens, with their largest marginal."""
    out: list[dict] = []
    last = -2
    for i, word in enumerate(SPAN_WORD.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] |= {"end": word.end(), "score": max(out[-1]["score"], float(p[i]))}
            else:
                out.append({"start": word.start(), "end": word.end(), "score": float(p[i])})
            last = i
    return out


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: score, toxic spans with offsets.

    A null or empty text has no tokens, no spans and the score of a text without a
    sign of toxicity; rows that repeat a document are scored each; an empty table gives
    no rows; other columns are not read. Texts are scored some ``SLICE`` bytes at a time,
    one very long text by itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_features()
        for batch in batches:
            for at, count in common.slices(batch["t"], 1000, SLICE):
                part = batch.slice(at, count)
                texts = part["t"].to_pylist()
                summary, p, sizes = summaries(held.value, features, texts)
                ends = np.cumsum(sizes)
                found = [spans_of(t, p[e - n:e]) if (p[e - n:e] >= 0.5).any() else [] for t, e, n in zip(texts, ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(scores_of(held.value, summary)), pa.array(found, span)], ["doc_id", "score", "spans"])

    narrow = common.only(docs, doc_id=F.col(doc_id).cast("long"), t=F.coalesce(F.col(text), F.lit("")))
    return narrow.mapInArrow(run, "doc_id long, score double, spans array<struct<start: bigint, end: bigint, score: double>>")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """One document in five is never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled rows of each class, none of them held out.

    Rows are taken in the order of a hash of their identifier. Null labels and
    identifiers are not used; of rows that repeat an identifier, one is. Without labels of both
    classes every score is the share of toxic labels.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "toxic") for c in (0, 1)]
    few = common.union_all(chosen).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most 2 * sample rows
    texts = common.only(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")))
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    return fit([r.text for r in rows], np.array([r.toxic for r in rows], np.int64), share)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.read(spark, folder, "documents")
    model = train(docs, common.read(spark, folder, "labels"))
    found = score(docs, model)
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}
