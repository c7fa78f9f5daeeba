"""Shared Spark views used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators.anomaly import any_anomaly, zscore_by_category, zscore_global
from tallyspark.operators.rules import categorize_weighted
from tallyspark.session import materialize
from tallyspark.sources.tables import expenses, expenses_raw, load  # noqa: F401


def categorized(spark: SparkSession, sf: str) -> DataFrame:
    """Clean expenses + weighted category, confidence and method."""
    return categorize_weighted(expenses(spark, sf))


def categorized_once(spark: SparkSession, sf: str) -> DataFrame:
    """The same, written once: for queries that read it several times."""
    return materialize(categorized(spark, sf))


def flagged_once(spark: SparkSession, sf: str) -> DataFrame:
    """Categorised rows with the statistical anomaly flags, written once."""
    return materialize(any_anomaly(zscore_by_category(zscore_global(categorized_once(spark, sf)))))
