"""Connected components of a link table, by alternating large and small stars on DataFrames.

Every round is a few joins and hash aggregations; links, labels and components stay distributed.
A node with very many links is the hot side of a plain join, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.work import Workspace

MAX_ROUNDS = 60


def is_star(edges: DataFrame) -> bool:
    """True if every node has one edge at most, to a node without one: (node, smallest) pairs."""
    twice = edges.groupBy("u").count().where("count > 1").limit(1)
    chained = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
    return not twice.take(1) and not chained.take(1)


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(work: Workspace, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node."""
    edges = work.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for k in range(MAX_ROUNDS):
        if is_star(edges):
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        old, edges = edges, work.save((small_star if k % 2 else large_star)(edges), "edges")
        work.drop(old)
    raise RuntimeError("components did not settle")
