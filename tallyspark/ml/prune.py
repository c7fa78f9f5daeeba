"""min_samples_split for a fitted forest.

Spark's tree learner has a smallest leaf but no smallest node to split.  A saved forest is a table of
nodes, so the rule is applied there: inner nodes with fewer training rows than asked become leaves,
with the class counts that they already carry, and what stood below them goes.  Counts are the rows drawn
for the tree, repeats included, so they only fall on the way down: a node goes exactly if its parent is
too small.  Nodes are numbered anew in the same (depth-first) order, tree by tree.
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import ensure_checkpoint_dir, materialize


def pruned_nodes(nodes: DataFrame, least: int) -> DataFrame:
    """The node table (treeID, nodeData) without splits of nodes under ``least`` rows."""
    n = nodes.select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    parents = n.where(inner).select("treeID", F.explode(F.array("leftChild", "rightChild")).alias("id"), F.col("rawCount").alias("parent"))
    kept = n.join(parents, ["treeID", "id"], "left").where(F.col("parent").isNull() | (F.col("parent") >= least))
    kept = kept.withColumn("new", (F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1).cast("int"))  # one tree's nodes
    kept = materialize(kept)
    for side in ("leftChild", "rightChild"):
        numbers = kept.select("treeID", F.col("id").alias(side), F.col("new").alias(f"new_{side}"))
        kept = kept.join(numbers, ["treeID", side], "left")
    split = inner & (F.col("rawCount") >= least)
    none = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    return kept.select("treeID", F.struct(
        F.col("new").alias("id"), "prediction", "impurity", "impurityStats", "rawCount", F.when(split, F.col("gain")).otherwise(-1.0).alias("gain"),
        F.when(split, F.col("new_leftChild")).otherwise(-1).alias("leftChild"), F.when(split, F.col("new_rightChild")).otherwise(-1).alias("rightChild"),
        F.when(split, F.col("split")).otherwise(none).alias("split")).alias("nodeData"))


def with_min_samples_split(spark: SparkSession, forest: RandomForestClassificationModel, least: int) -> RandomForestClassificationModel:
    """The forest as it would vote if no node under ``least`` training rows had been split."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"forest-{uuid.uuid4().hex}")
    forest.write().save(path)
    pruned_nodes(spark.read.parquet(f"{path}/data"), least).write.parquet(f"{path}/pruned")
    at = lambda part: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    fs = at("data").getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at("data"), True)
    fs.rename(at("pruned"), at("data"))
    out = RandomForestClassificationModel.load(path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return out
