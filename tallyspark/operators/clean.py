"""Cleaning (B1-B5): DataFrame -> DataFrame transforms.

All steps are narrow (no shuffle) except the de-duplication, which is a
single hash aggregation whose partial (map-side) step collapses even a
key that holds a third of all rows before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.dates import parse_date, ts_lit
from tallyspark.functions.money import clean_amount
from tallyspark.functions.text import clean_description
from tallyspark.session import materialize

ROW_ID = "row_id"


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Input order for "first wins" rules when a table has no key.

    Rows of files get their order when they are read
    (``order.with_input_order``).  Any other frame without the column is
    written once with an id, since an id made twice need not be the same.
    """
    if name in df.columns or df.isStreaming:
        return df
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def clean_descriptions(df: DataFrame, null_as_text: bool = True) -> DataFrame:
    """B1."""
    return df.withColumn("descripcion", clean_description(F.col("descripcion"), null_as_text))


def clean_amounts(df: DataFrame) -> DataFrame:
    """B2."""
    return df.withColumn("monto", clean_amount(F.col("monto")))


def parse_dates(df: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Parse ``fecha``; when the column is absent use ``as_of``."""
    if "fecha" in df.columns:
        return df.withColumn("fecha", parse_date(F.col("fecha")))
    as_of = as_of or dt.datetime.now().replace(microsecond=0)
    return df.withColumn("fecha", ts_lit(as_of))


def drop_invalid(df: DataFrame) -> DataFrame:
    """Keep rows with a description and a positive amount."""
    return df.where(F.col("descripcion").isNotNull() & F.col("monto").isNotNull()
                    & (F.col("monto") > 0) & (F.length("descripcion") > 0))


FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
               T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)


def drop_duplicates_first(df: DataFrame, subset: tuple[str, ...] = ("descripcion", "monto"),
                          order_col: str = ROW_ID) -> DataFrame:
    """One row per ``subset``, the earliest by ``order_col`` wins.

    Fixed-width carried columns: one hash aggregation, ``min(order_col)``
    and ``min_by(col, order_col)`` per column.  Its partial step runs
    before the shuffle, so duplicates (however many share a key) are
    reduced map-side and no group is gathered into one task.
    Otherwise (e.g. string columns, which would force a sort-based
    aggregate): the first ``order_col`` per key from the same hash
    aggregation, then a left-semi join on the unique ``order_col``.
    """
    others = [c for c in df.columns if c not in subset and c != order_col]
    if all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in others):
        aggs = [F.min(order_col).alias(order_col)] + [F.min_by(c, order_col).alias(c) for c in others]
        return df.groupBy(*subset).agg(*aggs).select(*df.columns)
    firsts = df.groupBy(*subset).agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(firsts, order_col, "left_semi")


def compute_once(df: DataFrame, *names: str) -> DataFrame:
    """Evaluate the named (regex-heavy) columns exactly once per row.

    Predicate pushdown substitutes column definitions into later filters,
    so a filter on a cleaned column would re-run the whole cleaning chain.
    Emitting those columns through a one-element ``inline`` (a Generate
    node, codegen'd, no shuffle) keeps later filters above the computation.
    All other columns stay outside, so that unused ones are still pruned.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    made = df.select(*rest, F.inline(F.array(row)))
    return made.select(*[F.col(f"`{c}`") for c in df.columns])


def clean_expenses(df: DataFrame, null_description_as_text: bool = True,
                   as_of: dt.datetime | None = None,
                   subset: tuple[str, ...] = ("descripcion", "monto")) -> DataFrame:
    """B1-B5 in the reference order.

    Dates play no part in the filters and the key: they are parsed after
    them, and not at all where no one asks for them.
    """
    df = with_row_id(df)
    df = compute_once(clean_amounts(clean_descriptions(df, null_description_as_text)), "descripcion", "monto")
    return drop_duplicates_first(parse_dates(drop_invalid(df), as_of), subset)
