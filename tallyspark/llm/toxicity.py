"""Toxicity by a classifier chain.

A chain predicts the categories one after another; the linear model of a category sees the text's
features and the probabilities of the categories before it.  While training, those probabilities
are out-of-fold predictions, so that a later model learns from what it will really be given.

The labels hold one category, ``toxic``.  The chain's earlier categories are defined on top of it:
``marked`` (the text holds words that only toxic texts use: learned from the training rows) and
``heavy`` (such words make up a high share of a toxic text); the last category is ``toxic`` itself.

Features are hashed words, word beginnings of 4 and 5 bytes, and inside runs of more than LONG_RUN bytes
(text without blanks) all pieces of LONG_GRAM bytes; present or not, over whole texts and whole words.
Training uses at most about TRAIN_ROWS labelled rows and TRAIN_CHARS characters of them (documented
bounds; an even sample of whole texts by a hash of the id); scoring reads every document in Arrow batches with the weights broadcast
(3 x 2**FEATURE_BITS numbers).

Defined results: null and wordless texts have no features and get the chain's value for no evidence,
never flagged; with no or only one-sided labels nothing is flagged and all probabilities are 0;
repeated rows get equal results; very long texts are scored whole; an empty table gives an empty
table; labels without a document, or null, are ignored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import runs, share, small_batches, utf8
from tallyspark.llm.words import WordHasher, grams, mix

CATEGORIES = ("marked", "heavy", "toxic")
FEATURE_BITS = 18
PREFIXES = (4, 5)
LONG_RUN, LONG_GRAM = 32, 9
FACTOR = 0x2545F4914F6CDD1D
TRAIN_ROWS = 12_000
TRAIN_CHARS = 100_000_000
FOLDS = 3
STEPS = 300
MIN_DOCS, CHI_SQUARED, MAX_FEATURES, SMOOTH = 3, 25.0, 1 << 14, 10.0
RESULT = "struct<marked: double, heavy: double, toxic: double, flagged: boolean>"
BYTES = 1 << 22


def word_hasher() -> tuple[WordHasher, np.ndarray]:
    """Words are letters and all bytes above ASCII, read in lower case; and each byte's mixed value."""
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    lower = np.arange(256)
    lower[65:91] += 32
    return WordHasher(inside, lower), mix(lower.astype(np.uint64) + np.uint64(1))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each row; rows are taken some BYTES at a time."""
    hasher, mixed = word_hasher()
    number = lambda x, kind: (mix(x + np.uint64(kind)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
    raw, offsets = utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1)
        part, local = raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        starts, ends = runs(hasher.inside[part], local)
        length = ends - starts
        words, firsts = hasher.words(part, local)
        made, used = [number(words, 0)], [np.ones(len(starts), bool)]
        for size in PREFIXES:
            beginning = grams(mixed[part], size, FACTOR)
            longer = length > size
            value = np.zeros(len(starts), np.uint64)
            value[longer] = beginning[starts[longer]]
            made.append(number(value, size))
            used.append(longer)
        ids, used_ = np.stack(made), np.stack(used)
        # long runs have no blanks to cut them into words, so every place in them counts
        long = np.flatnonzero(length > LONG_RUN)
        count = length[long] - LONG_GRAM + 1
        place = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(long) else starts[:0], count) + np.arange(count.sum())
        inner = number(grams(mixed[part], LONG_GRAM, FACTOR)[place], LONG_GRAM) if len(place) else np.zeros(0, np.int32)
        inner_firsts = np.searchsorted(place, local)
        for k, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
            yield np.unique(np.concatenate([ids[:, lo:hi][used_[:, lo:hi]], inner[inner_firsts[k]:inner_firsts[k + 1]]]))
        at = to


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def margin(self, ids: np.ndarray, bounds: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        return sums[bounds[1:]] - sums[bounds[:-1]] + earlier @ self.extra + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scale of each feature: its smoothed log ratio between the classes, 0 where that is no more than chance.

    Chance is judged by a chi-squared test of the feature's presence; at most MAX_FEATURES stay.
    """
    size, rows, n = 1 << FEATURE_BITS, np.repeat(np.arange(len(y)), np.diff(bounds)), len(y)
    ones = max(y.sum(), 1)
    there = np.bincount(ids, minlength=size)
    inside = np.bincount(ids[y[rows] == 1], minlength=size)
    expected = there * ones / n
    spread = expected * (1 - there / n) * (n - ones) / n
    chance = np.where(there >= MIN_DOCS, (inside - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)
    kept = chance > CHI_SQUARED
    if kept.sum() > MAX_FEATURES:
        kept &= chance >= np.sort(chance)[-MAX_FEATURES]
    ratio = np.log((inside + SMOOTH * ones / n) / (ones + SMOOTH)) - np.log((there - inside + SMOOTH * (n - ones) / n) / (n - ones + SMOOTH))
    return np.where(kept, ratio, 0.0)


def fit(ids: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> Linear:
    """Logistic regression on scaled features by accelerated gradient steps over all rows."""
    scale = telling(ids, bounds, y)
    used = np.flatnonzero(scale)
    place = np.zeros(len(scale), np.int64)
    place[used] = np.arange(len(used))
    rows = np.repeat(np.arange(len(y)), np.diff(bounds))
    there = scale[ids] != 0
    rows, cols = rows[there], place[ids[there]]
    by = scale[used][cols]
    wide, n = earlier.shape[1], len(y)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    # step sizes: the inverse of a diagonal bound on the loss's curvature, so rare features move as fast as common ones
    reach = np.bincount(rows, np.abs(by), n) + earlier.sum(axis=1) + 1
    curve = 0.25 * np.concatenate([np.bincount(cols, np.abs(by) * reach[rows], len(used)), earlier.T @ reach, [reach.sum()]]) / n
    rate = 1 / (curve + l2)
    w = v = np.zeros(len(used) + wide + 1)
    w[-1] = np.log(share / (1 - share))
    v = w.copy()
    for k in range(STEPS):
        margin = np.bincount(rows, by * v[cols], n) + earlier @ v[len(used):-1] + v[-1]
        error = (sigmoid(margin) - y) / n
        g = np.concatenate([np.bincount(cols, by * error[rows], len(used)), earlier.T @ error, [error.sum()]])
        g[:-1] += l2 * v[:-1]
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    weights = np.zeros(1 << FEATURE_BITS)
    weights[used] = w[:len(used)] * scale[used]
    return Linear(weights, w[len(used):-1], float(w[-1]))


@dataclass
class Chain:
    models: list[Linear]
    threshold: float

    def probabilities(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p = np.zeros((len(bounds) - 1, 0))
        for model in self.models:
            p = np.concatenate([p, sigmoid(model.margin(ids, bounds, p))[:, None]], axis=1)
        return p


def subset(ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [ids[bounds[r]:bounds[r + 1]] for r in rows]
    return np.concatenate([*parts, np.zeros(0, ids.dtype)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(int)


def categories(ids: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Targets of the chain (rows x CATEGORIES) from the toxic labels."""
    size, rows = 1 << FEATURE_BITS, np.repeat(np.arange(len(toxic)), np.diff(bounds))
    inside, outside = np.bincount(ids[toxic[rows] == 1], minlength=size), np.bincount(ids[toxic[rows] == 0], minlength=size)
    n1, n0 = max(toxic.sum(), 1), max((toxic == 0).sum(), 1)
    strong = (inside >= 3) & (inside / n1 > 20 * (outside + 0.5) / n0)
    hits = np.bincount(rows[strong[ids]], minlength=len(toxic))
    share = hits / np.maximum(np.diff(bounds), 1)
    some = share[(toxic == 1) & (hits > 0)]
    heavy = (hits > 0) & (toxic == 1) & (share >= (np.median(some) if len(some) else 1))
    return np.stack([(hits > 0) & (toxic == 1), heavy, toxic == 1], axis=1).astype(float)


def fit_chain(ids: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, seed: int = 11) -> Chain | None:
    """None if the labels hold one class only."""
    n = len(toxic)
    if n < 2 * FOLDS or not 0 < toxic.sum() < n:
        return None
    targets, fold = categories(ids, bounds, toxic), np.random.default_rng(seed).permutation(n) % FOLDS
    models, earlier = [], np.zeros((n, 0))
    for k in range(len(CATEGORIES)):
        y, unseen = targets[:, k], np.zeros(n)
        for f in range(FOLDS):  # out-of-fold predictions for the models that follow
            rows, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = fit(*subset(ids, bounds, rows), earlier[rows], y[rows])
            unseen[rest] = sigmoid(part.margin(*subset(ids, bounds, rest), earlier[rest]))
        models.append(fit(ids, bounds, earlier, y))
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return Chain(models, cut_point(earlier[:, -1], toxic))


def cut_point(p: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold predictions, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(toxic[order])
    f1 = 2 * good / (np.arange(1, len(p) + 1) + toxic.sum())
    k = int(f1.argmax())
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + after) / 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> Chain | None:
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    known = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").where(F.length(F.trim("text")) > 0)  # about max_rows small rows at most
    rows, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share_of = min(1.0, max_rows / max(rows, 1), max_chars / max(chars, 1))  # a labelled id may stand in many rows
    if share_of < 1:
        known = known.where(F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 20)) < int((1 << 20) * share_of))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(features(batch.column(1)))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), lists], ["doc_id", "toxic", "ids"])

    rows = known.select("doc_id", "text", "toxic").mapInArrow(extract, "doc_id bigint, toxic int, ids array<int>").toArrow().sort_by("doc_id")
    ids = rows.column("ids").combine_chunks()
    sizes = np.array([len(x) for x in ids])
    return fit_chain(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(int), rows.column("toxic").to_numpy())


def toxicity(docs: DataFrame, chain: Chain | None, text: Column) -> Column:
    """Column struct<marked, heavy, toxic, flagged> for a text column."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = share(spark, chain)

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared()
        for batch in batches:
            found = list(features(batch))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(int)
            p = model.probabilities(np.concatenate([*found, np.zeros(0, np.int32)]), bounds) if model else np.zeros((len(batch), len(CATEGORIES)))
            flagged = (p[:, -1] >= model.threshold) & (np.diff(bounds) > 0) if model else np.zeros(len(batch), bool)
            yield pa.StructArray.from_arrays([*[pa.array(p[:, k]) for k in range(len(CATEGORIES))], pa.array(flagged)], [*CATEGORIES, "flagged"])

    return score.asNondeterministic()(text)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (decision), p_marked, p_heavy, p_toxic for every document."""
    found = docs.select("doc_id", toxicity(docs, train(docs, labels), F.col("text")).alias("_found"))
    return found.select("doc_id", F.col("_found.flagged").alias("toxic"), *[F.col(f"_found.{c}").alias(f"p_{c}") for c in CATEGORIES])
