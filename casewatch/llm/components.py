"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour to the smallest one.

    Large: neighbours above the node. Small: the node and its neighbours below.
    Minima are combined inside each task, so a hub is no hot group.
    """
    ends = edges.select("u", "v")
    if large:
        ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = ends.join(low, "u")
    if large:
        # Repeats go with the next small star.
        return linked.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    pairs = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return pairs.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of its component (``root``) for every node that has an edge.

    ``edges`` has long columns ``u`` and ``v``. Every round is a table in the shared
    folder; rounds end when a round changes nothing. The number of rounds grows with
    the logarithm of the longest chain.
    """
    above = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialize(above), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = materialize(_star(materialize(_star(now, large=True)), large=False))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
