"""Fitted forests as node tables, and scoring by joins with them."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewatch.session import scratch_path


def node_table(spark: SparkSession, model: RandomForestRegressionModel) -> DataFrame:
    """One row per node: tree, node, feature, cut, left_values, left, right, value, weight, rows, share.

    Inner nodes send a row left where the feature is at most ``cut``, or, for a feature
    of few values, where it is one of ``left_values``; leaves have no feature. ``weight``
    is the sum of row weights a node was fitted on, ``share`` the tree's part in the mean.
    The model is stored and its nodes read back by tasks: trees never pass the driver.
    """
    path = scratch_path(spark)
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    few = inner & (F.col("split.numCategories") != -1)
    parts = F.col("split.leftCategoriesOrThreshold")
    return data.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ~few, parts[0]).alias("cut"), F.when(few, parts).alias("left_values"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"), F.col("impurityStats")[0].alias("weight"), F.col("rawCount").alias("rows"),
        F.lit(1.0 / model.getNumTrees).alias("share"),
    )


def goes_left(features: Column) -> Column:
    value = F.get(features, F.col("feature"))
    return F.when(F.col("left_values").isNull(), value <= F.col("cut")).otherwise(F.array_contains("left_values", value))


def score_by_nodes(rows: DataFrame, nodes: DataFrame, key: list[str], depth: int, features: str = "_features") -> DataFrame:
    """Prediction of every row: ``key`` and ``_by_nodes``.

    Each row stands at the root of every tree; a join per level moves it to a child,
    and one at a leaf stays. Values are summed in the order of the trees.
    """
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    at = rows.select(*key, vector_to_array(features).alias("_x")).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(0))
    split = nodes.select("tree", "node", "feature", "cut", "left_values", "left", "right")
    for _ in range(depth):
        there = at.join(split, ["tree", "node"])
        child = F.when(goes_left(F.col("_x")), F.col("left")).otherwise(F.col("right"))
        at = there.select(*key, "_x", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(child).alias("node"))
    ends = at.select(*key, "tree", "node").join(nodes.select("tree", "node", "value", "share"), ["tree", "node"])
    each = F.array_sort(F.collect_list(F.struct("tree", "value")))
    total = F.aggregate(each, F.lit(0.0), lambda sum_, one: sum_ + one["value"])
    return ends.groupBy(*key).agg((total / F.count(F.lit(1))).alias("_by_nodes"))


def unbalanced(nodes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Inner nodes whose children do not hold their weight and rows between them."""
    child = nodes.select("tree", F.col("node").alias("child"), F.col("weight").alias("w"), F.col("rows").alias("r"))
    inner = nodes.filter("feature IS NOT NULL").select("tree", "node", "weight", "rows", F.explode(F.array("left", "right")).alias("child"))
    sums = inner.join(child, ["tree", "child"], "left").groupBy("tree", "node", "weight", "rows").agg(F.sum("w").alias("w"), F.sum("r").alias("r"))
    off = F.abs(F.col("w") - F.col("weight")) > tolerance * F.col("weight")
    return sums.filter(F.coalesce(off | (F.col("r") != F.col("rows")), F.lit(True)))
