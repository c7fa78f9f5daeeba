"""Aggregates over appends (E1, E2, E4, E6, E13, F1, F3 for a table that grows by A9).

A state table has one row per category and day: count, sum, mean, M2 (sum of squared deviations), least
and greatest amount, first and last date, and a sketch of the distinct descriptions.  States of
disjoint rows merge into the state of their union (Chan's rule for mean and M2), so an append reads the new rows
and the state, never the old rows.  Month, category and overall figures are merges of the same rows.

``append`` keeps the state in a versioned folder: a new version is written whole, then one small
pointer file is replaced.  The names of the batches already counted are part of the version, so a batch
that is sent again after a failure is not counted twice.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import ANOMALY_Z, CATEGORY_ANOMALY_Z, CATEGORY_MIN_SIZE
from tallyspark.sources.versions import Folder

MONEY = 2
GRAIN = ["categoria", "dia"]
PARTS = ["n", "total", "mean", "m2", "least", "greatest", "first_date", "last_date", "texts"]


def state_of(df: DataFrame, cat: str = "categoria", amount: str = "monto", date: str = "fecha", text: str = "descripcion") -> DataFrame:
    """The state of some rows; rows without an amount count nowhere."""
    a = F.col(amount)
    rows = df.where(a.isNotNull() & ~F.isnan(a)).select(F.col(cat).alias("categoria"), F.to_date(date).alias("dia"), a.alias("_a"), F.col(date).alias("_d"), F.col(text).alias("_t"))
    return rows.groupBy(*GRAIN).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_a").alias("total"), F.avg("_a").alias("mean"), (F.var_pop("_a") * F.count(F.lit(1))).alias("m2"),
        F.min("_a").alias("least"), F.max("_a").alias("greatest"), F.min("_d").alias("first_date"), F.max("_d").alias("last_date"), F.hll_sketch_agg("_t").alias("texts"))


def chan(one: Column, two: Column) -> Column:
    """State of the union of two disjoint sets of rows."""
    n = one["n"] + two["n"]
    apart = two["mean"] - one["mean"]
    return F.struct(n.alias("n"), (one["total"] + two["total"]).alias("total"), (one["mean"] + apart * two["n"] / n).alias("mean"),
                    (one["m2"] + two["m2"] + apart * apart * (one["n"] * two["n"] / n)).alias("m2"))


def merged(states: DataFrame, by: list[str]) -> DataFrame:
    """One state per key of ``by`` (a part of the grain, or nothing).

    The moments are folded pairwise over the states of a key, first in groups of a day's rows, so that
    a key with many days is folded map-side.
    """
    def fold(df: DataFrame, keys: list[str]) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("mean", "n", "total", "m2")))  # in an order of its own: equal whatever the partitioning
        out = df.groupBy(*keys).agg(parts.alias("_parts"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                                    F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.hll_union_agg("texts").alias("texts"))
        as_state = F.transform("_parts", lambda p: F.struct(p["n"].alias("n"), p["total"].alias("total"), p["mean"].alias("mean"), p["m2"].alias("m2")))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        return out.withColumn("_all", F.aggregate(as_state, zero, chan)).select(*keys, "_all.*", "least", "greatest", "first_date", "last_date", "texts")

    shard = F.pmod(F.xxhash64(*GRAIN), F.lit(64)) if all(g in states.columns for g in GRAIN) else F.lit(0)
    return fold(fold(states.withColumn("_shard", shard), [*by, "_shard"]), by)


def merge(one: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of disjoint tables from their states."""
    return merged(reduce(DataFrame.unionByName, others, one), GRAIN).select(*GRAIN, *PARTS)


def append(spark: SparkSession, path: str, batch: DataFrame, name: str) -> bool:
    """Count a categorised batch into the state at ``path``, once; False if its name is counted already."""
    folder = Folder(spark, path)
    old = folder.current()
    where = lambda version, part: f"{folder.root}/versions/{version}/{part}"
    new = state_of(batch)
    names = spark.createDataFrame([(name,)], "batch string")
    if old is not None:
        counted = spark.read.parquet(where(old, "batches"))
        if counted.where(F.col("batch") == name).take(1):
            return False
        new, names = merge(spark.read.parquet(where(old, "state")), new), counted.unionByName(names)
    version = uuid.uuid4().hex
    new.write.parquet(where(version, "state"))
    names.coalesce(1).write.parquet(where(version, "batches"))
    folder.point_to(version)
    folder.drop_old(version, old)
    return True


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state table, or None before the first append."""
    folder = Folder(spark, path)
    version = folder.current()
    return None if version is None else spark.read.parquet(f"{folder.root}/versions/{version}/state")


def _r(c: Column, d: int = MONEY) -> Column:
    return F.round(c, d)


def overall(state: DataFrame) -> DataFrame:
    """E1 and E9 without the median: count, sum, mean, max, min and sample std."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged(state, []).select(F.col("n").alias("total_gastos"), _r(F.col("total")).alias("monto_total"), _r(F.col("mean")).alias("monto_promedio"),
                                    F.col("greatest").alias("max"), F.col("least").alias("min"), _r(std).alias("std"))


def by_category(state: DataFrame) -> DataFrame:
    """E2."""
    return merged(state, ["categoria"]).select("categoria", _r(F.col("total")).alias("sum"), F.col("n").alias("count"), _r(F.col("mean")).alias("mean"))


def monthly(state: DataFrame) -> DataFrame:
    """E4."""
    return state.where("dia is not null").groupBy(F.year("dia").alias("año"), F.month("dia").alias("mes")).agg(_r(F.sum("total")).alias("monto"))


def daily(state: DataFrame) -> DataFrame:
    """E6."""
    return state.where("dia is not null").groupBy(F.col("dia").alias("fecha")).agg(_r(F.sum("total")).alias("monto"))


def kpis(state: DataFrame) -> DataFrame:
    """E13 and the estimated number of distinct descriptions."""
    categories = state.where("categoria is not null").agg(F.count_distinct("categoria").alias("categorias"))
    return merged(state, []).crossJoin(categories).select(F.col("n").alias("transacciones"), _r(F.col("total")).alias("total"), _r(F.col("mean")).alias("promedio"), "categorias", F.hll_sketch_estimate("texts").alias("descripciones"))


def flags(df: DataFrame, state: DataFrame, cat: str = "categoria", amount: str = "monto", threshold: float = ANOMALY_Z,
          cat_threshold: float = CATEGORY_ANOMALY_Z, min_size: int = CATEGORY_MIN_SIZE) -> DataFrame:
    """F1 and F3 for rows (new ones, say) against the statistics of everything that the state counts."""
    std = lambda: F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    whole = merged(state, []).select(F.col("mean").alias("_mean"), std().alias("_std"))  # one row
    each = merged(state, ["categoria"]).select(F.col("categoria").alias("_cat"), F.col("n").alias("_n"), F.col("mean").alias("_cmean"), std().alias("_cstd"))
    rows = df.crossJoin(F.broadcast(whole)).join(each, F.col(cat).eqNullSafe(F.col("_cat")), "left")
    z = F.when(F.col("_std") > 0, F.abs((F.col(amount) - F.col("_mean")) / F.col("_std")))
    cz = F.when((F.col("_n") > min_size) & (F.col("_cstd") > 0), F.abs((F.col(amount) - F.col("_cmean")) / F.col("_cstd")))
    return rows.withColumns({"z_score": z, "is_anomaly": F.coalesce(z > threshold, F.lit(False)), "is_category_anomaly": F.coalesce(cz > cat_threshold, F.lit(False))}) \
               .drop("_mean", "_std", "_cat", "_n", "_cmean", "_cstd")
