"""Dense ranks and true input order, without a window over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize

LOW_BITS = 33  # row position bits of monotonically_increasing_id


def global_rank(df: DataFrame, cols: list[str], name: str = "_rank") -> DataFrame:
    """0-based position of each row in the order of ``cols``.

    A range-partitioned sort is written once; a row's rank is its position
    in its partition plus the sizes of the partitions before it: a running
    sum over one number per shuffle partition, made by the driver.
    """
    done = materialize(df.orderBy(*cols).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", LOW_BITS)
    sizes = done.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    rows, total = [], 0
    for p, n in sorted(map(tuple, sizes.collect())):
        rows.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(rows, "_part bigint, _before bigint")
    at = F.col("_at").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    return (done.withColumn("_part", part).join(before, "_part")
                .withColumn(name, F.col("_before") + at).drop("_part", "_before", "_at"))


def place() -> list[Column]:
    """File, block start and place in the scan of a file source's rows."""
    meta = F.col("_metadata")
    return [meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"),
            F.monotonically_increasing_id().alias("_id")]


def with_input_order(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``name`` = position in (file path, block start, row) order, from the columns of ``place``.

    Spark packs files into tasks by size, so a row id made at the scan
    does not follow file order.  Rows are written once with their place;
    the blocks (one row each) are ranked by path and start, and a row's id
    is its block's rank and its place in the block.  A table that has the
    column already keeps it.
    """
    if name in df.columns:
        return df.drop("_file", "_block", "_id")
    rows = materialize(df)
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"))
    ranked = global_rank(blocks, ["_file", "_block"])
    return (rows.join(ranked, ["_file", "_block"])
                .withColumn(name, F.shiftleft("_rank", LOW_BITS) + F.col("_id") - F.col("_first"))
                .drop("_file", "_block", "_id", "_first", "_rank"))
