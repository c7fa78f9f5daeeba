"""Choose rows of a wide table by a table of ids without shuffling the others.

A plain join would move every text through the shuffle to find the few that are asked for.  First
a bitmap of hashed ids is broadcast, whose size is bounded (MAX_BITS bits, 16 MB, however many ids
there are); rows whose bit is not set can't be among the ids.  The others, few unless the ids
are most of the table, meet the ids in an exact join.  With more ids than bits the bitmap lets all
rows through, and the join alone decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 15  # bits of one bitmap row, fixed by bitmap_construct_agg
MAX_BITS = 1 << 27
BITS_PER_ID = 16


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.floor(h / PAGE).cast("int"), (h % PAGE).cast("int")


def split(docs: DataFrame, ids: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the ids, rows that are not); rows with a null id are not."""
    n, bits = ids.count(), PAGE
    while bits < min(n * BITS_PER_ID, MAX_BITS):
        bits *= 2
    page, at = _place(F.col(col), bits)
    pages = ids.select(page.alias("_byid_page"), at.cast("long").alias("_byid_at")).groupBy("_byid_page").agg(F.bitmap_construct_agg("_byid_at").alias("_byid_map"))
    # MAX_BITS / 8 bytes at most
    own = F.struct(*docs.columns).alias("_byid_row")  # so that no column of the table can clash
    tested = docs.select(own, F.when(F.col(col).isNotNull(), page).alias("_byid_page"), at.alias("_byid_at")).join(F.broadcast(pages), "_byid_page", "left")
    byte = F.conv(F.hex(F.substring("_byid_map", F.floor(F.col("_byid_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("_byid_at") % 8)) % 2 == 1, F.lit(False))
    return tested.where(hit).select("_byid_row.*"), tested.where(~hit).select("_byid_row.*")


def among(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``docs`` whose ``col`` is in ``ids`` (a table with the same column)."""
    maybe, _ = split(docs, ids, col)
    return maybe.join(ids, col, "left_semi")


def not_among(docs: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of ``docs`` whose ``col`` is not in ``ids``; a null is in no table."""
    maybe, rest = split(docs, ids, col)
    return rest.unionByName(maybe.join(ids, col, "left_anti"))
