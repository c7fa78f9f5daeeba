"""Statistical anomaly flags.

Group statistics are computed by a partial/final hash aggregation and
joined back; they are never computed with a window partitioned by the
group (which would pull a whole category -- possibly a third of the
table -- into one task).  Spark broadcasts the statistics if their bytes
allow it, and otherwise splits a hot group's join.  Rows and statistics
both read the given frame: give it materialised where it is dear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.constants import (ANOMALY_Z, CATEGORY_ANOMALY_Z, CATEGORY_MIN_SIZE,
                                  MIN_ROWS_FOR_DETECTION)

def zscore_global(df: DataFrame, column: str = "monto", threshold: float = ANOMALY_Z) -> DataFrame:
    """|x - mean| / sample std > threshold; std 0 or undefined -> False."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std"))
    j = df.crossJoin(F.broadcast(stats))  # one row
    ok = F.col("_std").isNotNull() & (F.col("_std") != 0)
    z = F.when(ok, F.abs((F.col(column) - F.col("_mean")) / F.col("_std")))
    return (j.withColumn("z_score", z)
             .withColumn("is_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False)))
             .drop("_mean", "_std"))


def zscore_by_category(df: DataFrame, cat: str = "categoria", column: str = "monto",
                       threshold: float = CATEGORY_ANOMALY_Z,
                       min_size: int = CATEGORY_MIN_SIZE) -> DataFrame:
    """per-category z > 2.5, only in groups of more than 3 rows with std > 0."""
    stats = df.groupBy(cat).agg(F.count(F.lit(1)).alias("_n"), F.avg(column).alias("_cmean"),
                                F.stddev_samp(column).alias("_cstd"))
    stats = stats.withColumnRenamed(cat, "_cat")  # rows without a category are a group as well
    j = df.join(stats, F.col(cat).eqNullSafe(F.col("_cat")), "left").drop("_cat")
    ok = (F.col("_n") > min_size) & F.col("_cstd").isNotNull() & (F.col("_cstd") > 0)
    z = F.when(ok, F.abs((F.col(column) - F.col("_cmean")) / F.col("_cstd")))
    return (j.withColumn("is_category_anomaly", F.coalesce(z > threshold, F.lit(False)))
             .drop("_n", "_cmean", "_cstd"))


def any_anomaly(df: DataFrame, flags=("is_anomaly", "is_ml_anomaly", "is_category_anomaly")) -> DataFrame:
    """OR of the available flags (missing flags count as False)."""
    present = [F.coalesce(F.col(f), F.lit(False)) for f in flags if f in df.columns]
    out = F.lit(False)
    for p in present:
        out = out | p
    return df.withColumn("is_any_anomaly", out)


def detect_anomalies(df: DataFrame, cat: str = "categoria", column: str = "monto",
                     use_isolation_forest: bool = True, min_rows: int = MIN_ROWS_FOR_DETECTION,
                     **iforest_args) -> DataFrame:
    """F1 + F2 + F3 + F4 in the reference order; < 10 rows -> all flags False."""
    if df.limit(min_rows).count() < min_rows:
        out = df
        for f in ("is_anomaly", "is_ml_anomaly", "is_category_anomaly", "is_any_anomaly"):
            out = out.withColumn(f, F.lit(False))
        return out
    out = df
    if use_isolation_forest:
        from tallyspark.operators.iforest import isolation_forest_flags
        out = isolation_forest_flags(out, **iforest_args)
    out = zscore_global(out, column)
    if cat in df.columns:
        out = zscore_by_category(out, cat, column)
    return any_anomaly(out)


def anomaly_summary(df: DataFrame) -> DataFrame:
    """total flagged and per-method counts in one aggregation."""
    def cnt(flag):
        if flag in df.columns:
            return F.count_if(F.coalesce(F.col(flag), F.lit(False)))
        return F.lit(0).cast("bigint")
    return df.agg(cnt("is_any_anomaly").alias("total_detectadas"),
                  cnt("is_ml_anomaly").alias("ml_anomalies"),
                  cnt("is_category_anomaly").alias("category_anomalies"),
                  cnt("is_anomaly").alias("statistical_anomalies"))
