"""Relational TF-IDF with the weighting of the reference vectorisers.

tokens = maximal runs (>= 2) of letters/numbers/underscore; terms =
tokens + adjacent-token bigrams; idf = ln((1 + n) / (1 + df)) + 1;
optional sublinear tf = 1 + ln(tf); min/max document frequency filters
first, then the ``max_features`` most frequent terms (corpus count,
ties alphabetical); rows L2-normalised.

Every step is a Spark aggregation or join.  Texts are dealt out by
document before they become terms: the shuffle carries each text once
instead of its terms, long documents are spread over the tasks, and the
counts by document need no shuffle of their own.  The number of tasks
follows the bytes of the texts (TASK_BYTES each), since texts take many
times their size when they are terms; a fixed number of tasks, or tasks
merged by the size of the texts, would grow in memory with the corpus.  Rows that share an id
(or have none) are one document, counted in one task by a hash
aggregation that spills.  The vocabulary is a top-k
(TakeOrderedAndProject, bounded by ``max_features``) and is broadcast,
and the per-document norm is a window over one document's terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize

TASK_BYTES = 4 << 20
TOKEN_RX = r"[\p{L}\p{N}_]{2,}"


def terms(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    toks = F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_RX), 0)
    bigrams = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    all_terms = F.concat(toks, F.filter(bigrams, lambda x: x.isNotNull()))
    return docs.select(F.col(doc_col).alias("doc"), F.explode(all_terms).alias("term"))


def vocabulary(stats: DataFrame, n_docs: DataFrame, max_features: int | None, min_df: float, max_df: float) -> DataFrame:
    """(term, df, cf, n): of (term, df, cf) those within the document frequency bounds, the
    ``max_features`` most frequent ones, ties alphabetical."""
    stats = stats.crossJoin(F.broadcast(n_docs))
    stats = stats.where((F.col("df") >= min_df) &
                        (F.col("df") <= F.floor(F.lit(max_df) * F.col("n"))
                         if max_df < 1.0 else F.lit(True)))
    if max_features:
        stats = stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features)
    return stats


def tfidf(docs: DataFrame, doc_col: str, text_col: str, max_features: int | None = 1000,
          min_df: int = 1, max_df: float = 1.0, sublinear_tf: bool = False) -> DataFrame:
    """(doc, term, weight) for every document and vocabulary term it contains."""
    # the counts are written once: statistics and weights both read them
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    dealt = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).repartition(size // TASK_BYTES + 1, "doc")
    tf = materialize(terms(dealt, "doc", "text").groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    n_docs = docs.select(F.count(F.lit(1)).alias("n"))  # one row
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    stats = vocabulary(stats, n_docs, max_features, min_df, max_df)
    vocab = stats.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # the vocabulary holds at most max_features rows
    j = tf.join(F.broadcast(vocab) if max_features else vocab, "term")
    tfw = (1 + F.log(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    w = j.select("doc", "term", (tfw * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return w.select("doc", "term", (F.col("w") / norm).alias("weight"))
