"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts lineage, survives lost executors, and gives Spark file sizes to plan with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.session import ensure_checkpoint_dir


class Workspace:
    """A folder of Parquet tables; ``drop`` removes those that are no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *dropped: DataFrame) -> None:
        for df, path in self.tables:
            if any(df is x for x in dropped):
                remove(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is y for y in dropped)]

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[df for df, _ in self.tables if not any(df is x for x in kept)])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
