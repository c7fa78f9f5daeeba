"""Small helpers for operators whose tasks work on Arrow batches with numpy."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
# white space of the word rule `[^\x20\x09-\x0D]+`; all ASCII, so it can be tested on UTF-8 bytes
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows per Arrow batch, since one row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def share(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value together with its class, for workers that have no copy of this package."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


@contextmanager
def shared(spark: SparkSession, value: Any) -> Iterator[Callable[[], Any]]:
    """The same for a value that is needed only until some tables are written; then it is released."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    try:
        yield lambda: pickle.loads(held.value)
    finally:
        held.destroy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n+1 offsets of the rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def strings(column: pa.Array) -> list[str]:
    """Rows as Python strings (null: empty)."""
    return pc.fill_null(column, "").to_pylist()


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses a row's border."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions can use many times but Spark computes once.

    A one-element ``inline`` is a Generate, across which Catalyst doesn't copy expressions.
    """
    made = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", made)
