"""Model bundles (D14): a fitted pipeline and the rule table, saved and restored as one.

A bundle folder holds versions and one small pointer file:

    <path>/versions/<id>/pipeline, <path>/versions/<id>/rules     written first, never changed
    <path>/CURRENT                                                the id, put in place by one rename

A save that breaks off leaves the pointer on the old version, so readers see the old bundle or the new
one.  The version before the current one stays for readers that have just read its name.  A folder
without a pointer is "not trained" (None); every other fault is an error and changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators.rule_table import SCHEMA, weighted_rules
from tallyspark.sources.versions import Folder

@dataclass
class Bundle:
    model: PipelineModel
    rules: DataFrame
    version: str


def save_bundle(spark: SparkSession, model: PipelineModel, path: str, rules: DataFrame | None = None) -> str:
    """Write a new version, then point to it; returns the version's id."""
    folder, version = Folder(spark, path), uuid.uuid4().hex
    old = folder.current()
    where = f"{folder.root}/versions/{version}"
    model.write().save(f"{where}/pipeline")
    (weighted_rules(spark) if rules is None else rules).select("category", "ord", "weight_tenths", "keyword").write.parquet(f"{where}/rules")
    folder.point_to(version)
    folder.drop_old(version, old)
    return version


def load_bundle(spark: SparkSession, path: str) -> Bundle | None:
    """The current version, or None if nothing was ever saved here."""
    folder = Folder(spark, path)
    version = folder.current()
    if version is None:
        return None
    where = f"{folder.root}/versions/{version}"
    return Bundle(PipelineModel.load(f"{where}/pipeline"), spark.read.schema(SCHEMA).parquet(f"{where}/rules"), version)
