"""Isolation forest (F2), after Liu, Ting & Zhou (ICDM 2008).

Spark ML has no isolation forest, so it is built from Spark pieces:

1. **Sample** -- a pool of about ``2 * trees * psi`` rows is drawn with one
   hash per row (narrow filter); the pool is replicated once per tree and
   each tree keeps the ``psi`` rows with the smallest per-tree hash.  The
   pool size depends only on ``trees`` and ``psi``, never on the table,
   so the per-tree window is bounded.  Randomness comes only from
   (seed, tree, row key): results do not depend on partitioning.
2. **Build** -- ``groupBy(tree).applyInPandas`` grows one tree per group
   (numpy, ``psi`` rows) into flat node arrays.
3. **Score** -- the trees (at most ``trees * (2*psi - 1)`` nodes) become
   constant arrays; array functions walk all trees level by level in the
   JVM, so the scoring plan has no Python.
4. **Cut** -- rows whose score lies above the ``1 - contamination``
   quantile are flagged; the quantile is exact and distributed
   (``operators.stats``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.constants import ISO_CONTAMINATION, ISO_MAX_SAMPLES, ISO_TREES, SEED
from tallyspark.operators.stats import exact_quantile
from tallyspark.session import materialize

# This is the only module whose functions run inside Python workers (the
# tree builder).  Pickling them by value ships the code
# with the task, so executors need no installed copy of this package.
try:
    from pyspark import cloudpickle as _cloudpickle
    import sys as _sys
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 -- older cloudpickle: fall back to shipping the package
    pass

EULER = 0.5772156649015329
TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, left array<int>, "
               "right array<int>, size array<int>")


def avg_path(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out = np.where(n == 2, 1.0, out)
    big = n > 2
    nb = np.where(big, n, 3.0)
    out = np.where(big, 2.0 * (np.log(nb - 1.0) + EULER) - 2.0 * (nb - 1.0) / nb, out)
    return out


def _hash01(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(2 ** 31)) / F.lit(float(2 ** 31))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feature, threshold, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feature)
        feature.append(-1); threshold.append(0.0); left.append(-1); right.append(-1); size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        q = int(rng.choice(usable))
        t = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] < t
        if go_left.all() or not go_left.any():
            return me
        feature[me], threshold[me] = q, t
        left[me] = node(idx[go_left], depth + 1)
        right[me] = node(idx[~go_left], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feature, threshold, left, right, size


def literal(values: list, kind: str) -> F.Column:
    """A constant array, folded by the optimizer into one literal."""
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)")


@dataclass
class IsolationForestModel:
    trees: list[tuple]
    psi: int
    features: list[str]
    max_depth: int

    def node_arrays(self) -> dict[str, list]:
        """All trees' nodes end to end; a leaf's value is its path length, depth and what its rows would add."""
        out: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "roots": []}
        for feature, threshold, left, right, size in self.trees:
            at, depth = len(out["feature"]), [0] * len(feature)
            for k in range(len(feature)):  # parents stand before their children
                if feature[k] >= 0:
                    depth[left[k]] = depth[right[k]] = depth[k] + 1
            out["roots"].append(at)
            out["feature"] += list(feature)
            out["threshold"] += [float(x) for x in threshold]
            out["left"] += [x + at for x in left]
            out["right"] += [x + at for x in right]
            out["value"] += [d + float(avg_path(s)) for d, s in zip(depth, size, strict=True)]
        return out

    def score_column(self) -> F.Column:
        """Every tree is walked level by level with array functions over constant node arrays."""
        n = {k: literal(v, "double" if k in ("threshold", "value") else "int") for k, v in self.node_arrays().items()}
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        levels = F.sequence(F.lit(1), F.lit(self.max_depth + 1))

        def step(node: F.Column, _level: F.Column) -> F.Column:
            feature = F.get(n["feature"], node)
            lower = F.get(x, feature) < F.get(n["threshold"], node)
            return F.when(feature < 0, node).when(lower, F.get(n["left"], node)).otherwise(F.get(n["right"], node))

        total = F.aggregate(n["roots"], F.lit(0.0), lambda acc, root: acc + F.get(n["value"], F.aggregate(levels, root, step)))
        return F.pow(F.lit(2.0), -(total / len(self.trees)) / float(avg_path(self.psi)))

    def transform(self, df: DataFrame, out_col: str = "iso_score") -> DataFrame:
        return df.withColumn(out_col, self.score_column())


def fit_isolation_forest(df: DataFrame, features: list[str], key: str = "row_id",
                         trees: int = ISO_TREES, max_samples: int = ISO_MAX_SAMPLES,
                         seed: int = SEED) -> IsolationForestModel:
    n = df.count()
    psi = int(min(max_samples, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    pool_rate = min(1.0, 2.0 * trees * psi / max(n, 1))
    feats = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(features)]
    pool = df.where(_hash01(F.col(key), F.lit(seed)) < F.lit(pool_rate)).select(F.col(key).alias("_k"), *feats)
    tree_ids = df.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    cand = pool.crossJoin(F.broadcast(tree_ids))  # pool size is bounded by trees * psi
    cand = cand.withColumn("_u", _hash01(F.col("_k"), F.col("tree"), F.lit(seed)))
    from pyspark.sql import Window
    w = Window.partitionBy("tree").orderBy("_u", "_k")
    sample = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    k = len(features)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[[f"f{i}" for i in range(k)]].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        feat, thr, lft, rgt, size = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": [tree], "feature": [feat], "threshold": [thr], "left": [lft],
                             "right": [rgt], "size": [size]})

    built = sample.groupBy("tree").applyInPandas(build, TREE_SCHEMA).orderBy("tree").collect()
    forest = [(r["feature"], r["threshold"], r["left"], r["right"], r["size"]) for r in built]
    return IsolationForestModel(forest, psi, list(features), max_depth)


def with_time_features(df: DataFrame, date: str = "fecha") -> DataFrame:
    """Hour and weekday (Mon=0) of the transaction; missing date -> 0."""
    if date not in df.columns:
        return df.withColumn("_hour", F.lit(0)).withColumn("_weekday", F.lit(0))
    return (df.withColumn("_hour", F.coalesce(F.hour(date), F.lit(0)))
              .withColumn("_weekday", F.coalesce(F.weekday(date), F.lit(0))))


def isolation_forest_flags(df: DataFrame, amount: str = "monto", date: str = "fecha", key: str = "row_id",
                           contamination: float = ISO_CONTAMINATION, trees: int = ISO_TREES,
                           max_samples: int = ISO_MAX_SAMPLES, seed: int = SEED) -> DataFrame:
    """F2: ``iso_score`` and ``is_ml_anomaly`` on (amount, hour, weekday)."""
    feats = with_time_features(df, date)
    model = fit_isolation_forest(feats, [amount, "_hour", "_weekday"], key, trees, max_samples, seed)
    # scored once: the cut and the flags read the written table
    scored = materialize(model.transform(feats).drop("_hour", "_weekday"))
    cut = exact_quantile(scored, "iso_score", 1.0 - contamination)
    return scored.withColumn("is_ml_anomaly", F.coalesce(F.col("iso_score") > F.lit(cut), F.lit(False)))
