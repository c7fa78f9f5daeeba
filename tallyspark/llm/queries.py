"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import chat, decontam, html, langid, lexical, minhash, negatives, packing, quality, secretscan, substrings, toxicity, warc
from tallyspark.sources.tables import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(load(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(load(spark, sf_dir, "conversations"), spark)
    return chat.read_back(chat.format_conversations(rows))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_html(load(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(load(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(load(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(load(spark, sf_dir, "documents")).drop("spans")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_toxicity, op4_minhash_dedup, op5_length_buckets, op6_warc, op7_html_text, op8_quality_rules, op9_decontaminate, op10_secret_scan, op11_substring_dedup, op12_hard_negatives, op13_ranked_search)}
ORACLE = {"op2_chat_format": chat.oracle(), "op5_length_buckets": packing.oracle(), "op6_warc": warc.ORACLE, "op8_quality_rules": quality.oracle(),
          "op11_substring_dedup": substrings.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_ranked_search": lexical.ORACLE}
