"""Score each distinct description once and reuse it.

The reference memoises predictions per ``lower(strip(description))``.
On Spark the same effect is: aggregate the distinct keys (a partial hash
aggregation, so even a key holding a third of the rows is collapsed
map-side), score only those, and join the scores back on a 128-bit hash
of the key.  There is no hint: Spark broadcasts the scores if their bytes
allow it, and otherwise shuffles and splits a hot key (AQE).

For the rule categoriser the per-row expression (``categorize_weighted``)
is already a narrow projection, so this path pays off only for costly
scorers (the learned model).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import cache_key
from tallyspark.operators.rules import categorize_weighted
from tallyspark.session import materialize


def score_distinct(df: DataFrame, key: Column, scorer: Callable[[DataFrame], DataFrame], out_cols: list[str]) -> DataFrame:
    """Apply ``scorer`` (a frame with ``_key`` -> adds ``out_cols``) to each
    distinct key and join the result to every row.

    ``df`` is written once, since the keys and the join both read it.
    """
    df = materialize(df.drop(*out_cols).withColumn("_key", key))
    hashed = df.select("*", F.xxhash64("_key").alias("_h1"), F.xxhash64("_key", F.lit(1)).alias("_h2"))
    keys = hashed.groupBy("_h1", "_h2", "_key").agg(F.count(F.lit(1)).alias("_rows"))
    scored = scorer(keys).select("_h1", "_h2", *out_cols)
    return hashed.drop("_key").join(scored, ["_h1", "_h2"], "left").drop("_h1", "_h2")


def cache_stats(df: DataFrame, text_col: str = "descripcion") -> DataFrame:
    """Size, hits, misses and hit rate of an unbounded per-key cache."""
    key = cache_key(F.col(text_col))
    agg = df.agg(F.count(F.lit(1)).alias("total_predictions"), F.count_distinct(key).alias("cache_size"))
    return agg.select(
        "total_predictions", "cache_size",
        (F.col("total_predictions") - F.col("cache_size")).alias("cache_hits"),
        F.col("cache_size").alias("cache_misses"),
        F.round(F.when(F.col("total_predictions") > 0,
                       1 - F.col("cache_size") / F.col("total_predictions")).otherwise(0.0), 6)
         .alias("hit_rate"))


def categorize_distinct(df: DataFrame, text_col: str = "descripcion", scorer=None) -> DataFrame:
    """Apply ``scorer`` (DataFrame -> DataFrame adding categoria/confidence/method)
    once per distinct key and join the result back to every row."""
    scorer = scorer or categorize_weighted
    # the scorers normalise (lower, strip) themselves, so scoring the key equals
    # scoring any of its texts
    return score_distinct(df, cache_key(F.col(text_col)), lambda keys: scorer(keys.withColumn(text_col, F.col("_key"))),
                          ["categoria", "confidence", "method"])
