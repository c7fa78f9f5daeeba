"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in Spark (partial sums per task, then one small sum per
(language, bucket)); the log-probability matrix, at most MAX_LANGUAGES x 2**BITS, is broadcast and
whole texts are scored in numpy: the n-gram buckets of a batch form a sparse matrix (row ends and
bucket ids, all ones) that is multiplied with the log-probability matrix.

Texts are lower-cased; every character that is no letter counts as a blank, and a blank is put
before and after.  Only text and language of the training rows are used, and only the text when
predicting.

Defined results: a text that is null or has no letter gets ``und`` with score 0; with nothing to
learn from, every text gets ``und``; ties go to the language that sorts first; repeated rows get
equal results; very long texts are scored in slices of BLOCK positions, whose log-probabilities
add up; an empty table gives an empty table; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.arrow import share, small_batches, strings

BITS = 15
ORDERS = (1, 2, 3, 4)
ALPHA = 0.5
BLOCK = 1 << 18
TRAIN_ROWS = 100_000
MAX_LANGUAGES = 1000
UNKNOWN = "und"
RESULT = "struct<lang_pred: string, score: double>"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, log-probabilities
    prior: np.ndarray


def letter_table() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def blank_buckets() -> np.ndarray:
    """The buckets of n-grams made of blanks only; they say nothing."""
    return np.array([gram_buckets(np.full(n, 32, np.uint32), n, 1)[0] for n in ORDERS])


def gram_buckets(codes: np.ndarray, n: int, count: int) -> np.ndarray:
    """Buckets of the n-grams that start at the first ``count`` positions of ``codes``."""
    h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ codes[k:k + count]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int32)


def blocks(texts: list[str], letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of (codes, borders of the pieces, row of each piece); texts without a letter have none.

    Each piece ends with a tail of max(ORDERS) codes that starts no n-gram: blanks, or what comes
    next in a text that is cut in several pieces.
    """
    tail = max(ORDERS)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[codes]
        codes = np.concatenate([[np.uint32(32)], np.where(is_letter, codes, np.uint32(32)), np.full(tail + 1, 32, np.uint32)])
        has = bool(is_letter.any())
        if not has:
            continue
        for at in range(0, len(codes) - tail, BLOCK):
            piece = codes[at:at + BLOCK + tail]
            held.append(piece)
            rows.append(row)
            size += len(piece)
            if size >= BLOCK:
                yield pack(held, rows)
                held, rows, size = [], [], 0
    if held:
        yield pack(held, rows)


def pack(held: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in held])
    return np.concatenate([*held, np.full(max(ORDERS), 32, np.uint32)]), np.concatenate([[0], np.cumsum(lengths)]), np.array(rows)


def starts_gram(bounds: np.ndarray) -> np.ndarray:
    """False at the tail of each piece."""
    mask = np.ones(bounds[-1], bool)
    for k in range(1, max(ORDERS) + 1):
        mask[bounds[1:] - k] = False
    return mask


def loglik(model: Model, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text under each language (rows x languages); whether it has a letter."""
    total = np.zeros((len(texts), len(model.languages)))
    seen = np.zeros(len(texts), bool)
    step = max(1, BLOCK // max(1, len(model.languages) // 8))
    for codes, bounds, rows in blocks(texts, letters):
        seen[rows] = True
        at = np.flatnonzero(starts_gram(bounds))
        piece = np.searchsorted(bounds, at, "right") - 1
        for n in ORDERS:
            grams = gram_buckets(codes, n, bounds[-1])[at]
            for lo in range(0, len(at), step):
                part, owner = grams[lo:lo + step], piece[lo:lo + step]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                np.add.at(total, rows[owner[first]], np.add.reduceat(model.table[part], first, axis=0))
    return total, seen


def predict(model: Model, texts: list[str], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    total, seen = loglik(model, texts, letters)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = total + model.prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], np.where(seen, score, 0.0)


def shares(rows: dict[str, int], max_rows: int) -> dict[str, float]:
    """Share of each language's rows to learn from: small languages keep all, the others divide what is left evenly."""
    left, out = float(max_rows), {}
    for k, lang in enumerate(sorted(rows, key=lambda x: (rows[x], x))):
        quota = left / (len(rows) - k)
        out[lang] = min(1.0, quota / rows[lang])
        left -= min(float(rows[lang]), quota)
    return out


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) rows to learn from, about ``max_rows`` at most, and the number of all rows of each learned language.

    A dirty label column may hold any number of values: the MAX_LANGUAGES most frequent are learned.
    """
    named = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    rows = {r.lang: r.n for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    cuts = docs.sparkSession.createDataFrame([(lang, int((1 << 20) * share)) for lang, share in shares(rows, max_rows).items()], "lang string, cut int")
    chosen = named.join(F.broadcast(cuts), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.col("cut"))  # MAX_LANGUAGES cuts at most
    return chosen.select("lang", "text"), rows


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the given labelled rows; at most about ``max_rows`` of them (a documented bound)."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums, rows = letter_table(), {}, {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = np.array([*strings(batch.column(1)), ""], object)[:-1]
            for lang in set(langs):
                own = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                rows[lang] = rows.get(lang, 0) + int((langs == lang).sum())
                for codes, bounds, _ in blocks(list(texts[langs == lang]), letters):
                    mask = starts_gram(bounds)
                    for n in ORDERS:
                        own += np.bincount(gram_buckets(codes, n, bounds[-1])[mask], minlength=1 << BITS)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1), pa.string()), pa.array(np.concatenate([[-1], used]), pa.int32()),
                                              pa.array(np.concatenate([[rows[lang]], own[used]]), pa.int64())], ["lang", "bucket", "n"])

    chosen, known = learnable(docs, id_col, text_col, lang_col, max_rows)
    got = chosen.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # the model's size at most
    langs, buckets, n = (got.column(k).to_numpy() for k in ("lang", "bucket", "n"))
    languages = sorted(set(langs))
    index = {x: k for k, x in enumerate(languages)}
    where = np.array([index[x] for x in langs], int)
    counts = np.zeros((1 << BITS, len(languages)))
    gram = buckets >= 0
    counts[buckets[gram], where[gram]] = n[gram]
    prior = np.array([known[x] for x in languages], float)
    table = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * len(counts)))
    table[blank_buckets()] = 0
    return Model(languages, table, np.log(prior / max(prior.sum(), 1)))


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column struct<lang_pred, score> for a text column, scored in Arrow batches."""
    small_batches(spark)
    shared = share(spark, model)

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, known = letter_table(), shared()
        for batch in batches:
            langs, scores = predict(known, strings(batch), letters)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return score.asNondeterministic()(text)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = train(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language(docs.sparkSession, model, F.col("text")).alias("_found"))
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score")
