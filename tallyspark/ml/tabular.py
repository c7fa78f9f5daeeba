"""Tabular classifier on amount + weekday + month.

The label is *not* a feature (the category column leaked into the
features in the reference); weekday and month are one-hot encoded.
The hold-out is D5's stratified split.  Models are saved as versioned bundles
(D14); scoring is batch, and one transaction is a batch of one row.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import SEED
from tallyspark.ml.bundle import load_bundle, save_bundle
from tallyspark.ml.categorizer import stratified_split
from tallyspark.session import materialize


def _with_calendar(df: DataFrame) -> DataFrame:
    # a missing date has codes of its own: weekday 7, month 0
    return (df.withColumn("_dia_semana", F.coalesce(F.weekday("fecha"), F.lit(7)).cast("double"))
              .withColumn("_mes", F.coalesce(F.month("fecha"), F.lit(0)).cast("double")))


def train_tabular(df: DataFrame, label: str = "categoria", num_trees: int = 100,
                  seed: int = SEED) -> tuple[PipelineModel, float]:
    data = materialize(_with_calendar(df.where(F.col(label).isNotNull())).select("row_id", label, "monto", "fecha", "_dia_semana", "_mes"))
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    stages = [indexer,
              OneHotEncoder(inputCols=["_dia_semana", "_mes"], outputCols=["_dow_oh", "_mes_oh"],
                            handleInvalid="keep"),
              VectorAssembler(inputCols=["monto", "_dow_oh", "_mes_oh"], outputCol="_features"),
              RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=num_trees, seed=seed)]
    train, test = stratified_split(data, label, "row_id", seed=seed)
    fitted = Pipeline(stages=stages).fit(train)
    back = IndexToString(inputCol="prediction", outputCol="prediccion", labels=fitted.stages[0].labels)
    model = PipelineModel(stages=[*fitted.stages[1:], back])
    scored = model.transform(_with_calendar(test))
    acc = scored.agg(F.avg((F.col("prediccion") == F.col(label)).cast("double"))).first()[0]
    return model, acc


def save_tabular(model: PipelineModel, path: str) -> None:
    save_bundle(SparkSession.active(), model, path)


def load_tabular(path: str) -> PipelineModel | None:
    """``None`` only where nothing was saved."""
    bundle = load_bundle(SparkSession.active(), path)
    return bundle.model if bundle else None


def predict_one(model: PipelineModel, monto: float, fecha: dt.datetime | None = None) -> str:
    """The category of one transaction."""
    row = SparkSession.active().createDataFrame([(monto, fecha)], "monto double, fecha timestamp_ntz")
    return predict_tabular(model, row).first()["prediccion"]


def predict_tabular(model: PipelineModel, df: DataFrame) -> DataFrame:
    keep = df.columns
    return model.transform(_with_calendar(df)).select(*keep, "prediccion")
