"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and rereads it as the next stage's docs.  All stages but the last return the columns
that they were given.

- language: documents whose language is unknown (``und``: null text, no letter) or whose score is
  below MIN_SCORE go;
- near_duplicates: one document of each group of near copies (similarity of PERCENT or more) stays,
  the one with the smallest doc_id, or an arbitrary row of those that share it; rows are told apart by a
  number of their own, so unlike texts under one doc_id stay and copies without one go;
- decontaminate: documents that hold a benchmark item go;
- secrets: every finding is masked in the text, and n_chars follows; no document goes;
- pack: one row per piece of a document with its length bucket, batch and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, langid, minhash, packing, secretscan
from tallyspark.llm.byid import not_among
from tallyspark.llm.work import Workspace
from tallyspark.sources.tables import load

MIN_SCORE = 0.5
PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, name = langid.train(docs.where(~langid.held_out())), free_name(docs, "found")
    found = docs.withColumn(name, langid.language(spark, model, F.col("text")))
    sure = (F.col(name)["lang_pred"] != langid.UNKNOWN) & (F.col(name)["score"] >= MIN_SCORE)
    return found.where(sure).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline-rows")
    row = free_name(docs, "row")
    numbered = work.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written once: the number stays
    found = work.save(minhash.near_duplicates(numbered, row, "text", PERCENT).select(F.col("doc_id").alias(row), "component_id"), "found")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    first = work.save(found.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min_by(row, order).alias("first")), "first")
    others = work.save(found.join(first, "component_id").where(F.col(row) != F.col("first")).select(row), "others")
    kept = not_among(numbered, others, row).select(docs.columns)
    work.drop(found, first)
    return kept


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "items")
    found = decontam.with_matches(docs, load(spark, sf_dir, "benchmark"), name)
    return found.where(F.size(name) == 0).drop(name)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = secretscan.train(docs)
    name = free_name(docs, "masked")
    found = docs.withColumn(name, secretscan.redacted(docs, net, F.col("text")))
    size = F.when(F.col(name).isNotNull(), F.length(name).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.coalesce(name, "text"), "n_chars": size}).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pack", pack)]

# Naive Bayes, the network and the edit search can't be written in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, work.save(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return docs
