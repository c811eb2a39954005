"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a share of all words by its weight, at most ``most`` times its own
size. A document's expected copies are target over source size. The whole part is
certain; the fraction is rounded so that the words of a source are kept:

* Two documents with fractional copies are paired. Mass, counted in words, moves
  from one to the other, either way with the probability that keeps both
  expectations, until one of them has a whole number of copies.
* A leaf does this for one bucket of one source, ordered by size, and leaves at most
  one fractional document. Leaves have a bounded number of rows, so a source with a
  third of all rows is many leaves.
* Residuals of ``FAN_IN`` neighbours are combined in the same way, level by level,
  until a source has one. That last fraction goes to the nearer side.

So a source's words miss the target by at most half of one document. All draws
are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from casewatch.llm import common
from casewatch.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
LEAF_ROWS, FAN_IN = 1000, 64
WORD = r"[^\x20\x09-\x0D]+"
TINY = 1e-12


def ranked(sources: DataFrame) -> DataFrame:
    """Rank from 0 by source in code point order, null last, without one task for all.

    Rows are range-partitioned and numbered inside their partition; the counts of the
    partitions, one row each, give the offsets.
    """
    ordered = (
        sources.withColumn("last", F.col("source").isNull().cast("int"))
        .repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
        .withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("last", "source")))
    )
    held = materialize(ordered)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = held.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return held.join(offsets, "part").withColumn("rank", F.col("offset") + F.col("at") - 1).drop("last", "part", "at", "offset")


def water_level(sources: DataFrame, most: float) -> float:
    """Words per unit of weight, once no source is above its cap.

    One row of sums per round; a round caps the sources above and shares the excess
    by weight. The level only rises, so rounds end when no source is newly above.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = most * F.col("source_size") <= level * F.col("weight")
        capped, weight = sources.agg(F.sum(F.when(above, most * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not weight:
            return level
        risen = (total - (capped or 0)) / weight
        if risen <= level:
            return level
        level = risen


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: its size, rows, weight and target."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    choice = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = materialize(ranked(totals).withColumn("weight", choice))
    level = water_level(weighted, most)
    goal = F.least(F.col("source_size") * float(most), F.col("weight") * F.lit(level))
    return weighted.withColumn("target", goal)


def pivotal(rows: list[list], last: bool, seed: int) -> None:
    """Round the fractions of ``rows`` in place; each is [size, key, fraction, extra].

    The largest documents come first, so what is carried on tends to be small.
    """
    carry = None
    for row in sorted(rows, key=lambda r: (-r[0], r[1])):
        if carry is not None:
            draw = uniform(carry[1], row[1], seed)
            a, b = carry[2] * carry[0], row[2] * row[0]
            gain, loss = min(carry[0] - a, b), min(a, row[0] - b)  # of the carried one
            move = gain if draw * (gain + loss) < loss else -loss
            for one, mass, full in ((carry, a + move, carry[0]), (row, b - move, row[0])):
                one[2] = mass / full
                if one[2] <= TINY or one[2] >= 1 - TINY:
                    one[3], one[2] = int(one[2] > 0.5), 0.0
        open_ = [r for r in (carry, row) if r is not None and r[3] is None]
        carry = open_[0] if open_ else None
    if last and carry is not None:
        carry[3], carry[2] = int(carry[2] >= 0.5), 0.0


def uniform(a: int, b: int, seed: int) -> float:
    """A draw in [0, 1) that depends on the pair alone."""
    pair = np.array([a & (2**64 - 1), b & (2**64 - 1), seed], np.uint64)
    return float(common.grams(pair, 3)[0] >> np.uint64(11)) / 2**53


def level(open_rows: DataFrame, seed: int) -> DataFrame:
    """Round inside each (source, node); rows come back with ``extra`` set, one per node may stay open."""
    schema = "row long, source string, size long, key long, fraction double, extra int, node long, last boolean"

    def run(table: pa.Table) -> pa.Table:
        part = table.to_pydict()
        rows = [list(x) for x in zip(part["size"], part["key"], part["fraction"], part["extra"], strict=True)]
        pivotal(rows, part["last"][0], seed)
        names = table.schema.names
        return (
            table.set_column(names.index("fraction"), "fraction", pa.array([r[2] for r in rows], pa.float64()))
            .set_column(names.index("extra"), "extra", pa.array([r[3] for r in rows], pa.int32()))
        )

    return open_rows.groupBy("source", "node").applyInArrow(run, schema)


def copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """One row per document: sizes, target of its source, copies and words taken.

    A null or empty text has no words: it is taken once for each whole expected copy,
    which adds no words. Null sources are one source, ranked last. Rows that repeat a
    document are rounded each; a table without words has targets of 0; an empty table
    gives no rows; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = common.only(
        docs, doc_id=F.col(doc_id).cast("long"), source=F.col(source).cast("string"), k=common.text_key(F.col(doc_id), body),
        size=F.regexp_count(body, F.lit(WORD)).cast("long"), row=F.monotonically_increasing_id(),
    )
    sized = materialize(narrow)
    goals = targets(sized, weights, most)
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    both = (
        sized.alias("d").join(goals.alias("s"), F.expr("d.source <=> s.source"))
        .select("d.*", "source_size", "target", "rows", expected.alias("expected"))
        .withColumn("whole", F.floor(F.col("expected") + TINY))
        .withColumn("fraction", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    )
    key = F.xxhash64("k", "source", F.lit(seed))
    leaves = F.ceil(F.col("rows") / leaf_rows)
    first = both.filter((F.col("fraction") > TINY) & (F.col("size") > 0)).select(
        "row", "source", "size", key.alias("key"), "fraction", F.lit(None).cast("int").alias("extra"),
        F.pmod(F.xxhash64(key), leaves).alias("node"), (leaves == 1).alias("last"),
    )
    nodes = goals.agg(F.max(F.ceil(F.col("rows") / leaf_rows))).first()[0] or 1
    levels = 1 + math.ceil(math.log(nodes, FAN_IN) - 1e-9) if nodes > 1 else 1
    settled, at = [], first
    for depth in range(levels):
        done = materialize(level(at, seed + depth))
        settled.append(done.filter("extra IS NOT NULL").select("row", "extra"))
        at = done.filter("extra IS NULL").withColumn("node", F.floor(F.col("node") / FAN_IN)).withColumn("last", F.lit(depth + 2 == levels) | F.col("last"))
    extra = common.union_all(settled)
    return both.join(extra, "row", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0))).select(
        "doc_id", "source", "k", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options: float) -> DataFrame:
    """The documents of the mix, each as often as it is taken; same columns.

    Rows that repeat identifier, text and source are interchangeable: their copies
    are added up.
    """
    taken = copies(docs, doc_id, text, source, **options).groupBy("k", "source").agg(F.sum("copies").alias("n")).filter("n > 0")
    k = common.text_key(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct("*").alias("r"), k.alias("k"), F.col(source).cast("string").alias("source"))
    alone = rows.groupBy("k", "source").agg(F.first("r").alias("r"))
    joined = alone.alias("a").join(taken.alias("b"), F.expr("a.k = b.k AND a.source <=> b.source"))
    again = joined.select("r", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return again.select(*[F.col(f"r.`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return copies(common.read(spark, folder, "documents")).drop("k")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mixing": op3_mixing}
