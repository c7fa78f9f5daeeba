"""Exact order statistics without gathering a column into one task.

Spark's exact ``percentile``/``median`` merges every distinct value of
the column into a single final buffer, i.e. one task holds the whole
value set.  Instead, ``kth_smallest`` narrows the search with pivots:
each pass asks ``percentile_approx`` for values near the wanted rank,
counts exactly how many values lie below and at each of them, and goes
on with the segment that holds the rank.  A pivot is a value of the
column, so every pass leaves fewer values, and with three pivots around
the rank a pass leaves about one in a thousand.  The plan is the same at
every size; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize

ACCURACY = 10_000
NEAR = 0.0005


def _values(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def kth_smallest(vals: DataFrame, k: int, n: int) -> float:
    """k-th smallest (0-based) of the ``n`` values in column ``v``."""
    cur = vals
    while True:
        q = (k + 0.5) / n
        near = [max(q - NEAR, 0.0), q, min(q + NEAR, 1.0)]
        pivots = sorted(set(cur.agg(F.percentile_approx("v", near, ACCURACY)).first()[0]))
        below = [F.count_if(F.col("v") < p) for p in pivots]
        upto = [F.count_if(F.col("v") <= p) for p in pivots]
        counts = cur.agg(*[c.alias(f"c{i}") for i, c in enumerate(below + upto)]).first()
        lt, le = counts[:len(pivots)], counts[len(pivots):]
        low, low_n, high = None, 0, None  # the open segment (low, high) that holds the rank
        for p, a, b in zip(pivots, lt, le):
            if a <= k < b:
                return p
            if b <= k:
                low, low_n = p, b
            elif high is None:
                high, n_high = p, a
        cond = F.lit(True)
        if low is not None:
            cond = cond & (F.col("v") > low)
        if high is not None:
            cond = cond & (F.col("v") < high)
        cur = cur.where(cond)
        k, n = k - low_n, (n_high if high is not None else n) - low_n


def _next(vals: DataFrame, v: float, k: int) -> float:
    """The order statistic after rank ``k``, whose value is ``v``."""
    r = vals.agg(F.count_if(F.col("v") <= v).alias("le"), F.min(F.when(F.col("v") > v, F.col("v"))).alias("above")).first()
    return v if r["le"] > k + 1 or r["above"] is None else r["above"]


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Linear-interpolated quantile (numpy's default); NULL and NaN do not count.

    The value column alone is written once, so that no pass recomputes
    what stands before it.
    """
    vals = materialize(_values(df, col))
    n = vals.count()
    if n == 0:
        return None
    pos = q * (n - 1)
    k = int(pos)
    v = kth_smallest(vals, k, n)
    if pos == k or k + 1 >= n:
        return v
    after = _next(vals, v, k)
    return v if after == v else v + (after - v) * (pos - k)


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median; the mean of the two middle values of an even count."""
    return exact_quantile(df, col, 0.5)
