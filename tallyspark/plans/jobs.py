"""End-to-end jobs (G1-G3) as chains of DataFrame transforms."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import UNCATEGORISED
from tallyspark.functions.dates import calendar_columns
from tallyspark.ml.categorizer import IMPROVED, categorize_smart, load_model, predict_with_confidence
from tallyspark.operators import analytics as A
from tallyspark.operators.anomaly import detect_anomalies
from tallyspark.operators.clean import clean_expenses
from tallyspark.operators.present import preview
from tallyspark.operators.quality import narrow
from tallyspark.operators.report import build_report
from tallyspark.operators.rules import categorize_first_match, categorize_weighted
from tallyspark.operators.schema import standardize_columns
from tallyspark.session import materialize
from tallyspark.sources.files import load_data
from tallyspark.sources.ingest import parse_quick_list
from tallyspark.sources.sinks import save_processed, save_report_json


def add_time_features(df: DataFrame) -> DataFrame:
    """B7 as a transform."""
    if "fecha" not in df.columns:
        return df
    return df.select("*", *[c.alias(n) for n, c in calendar_columns(F.col("fecha")).items()])


def process_frame(raw: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """G1 body: standardise -> clean -> first-match categories -> calendar."""
    return (raw.transform(standardize_columns)
               .transform(lambda d: clean_expenses(d, as_of=as_of))
               .transform(categorize_first_match)
               .transform(add_time_features))


def insights(df: DataFrame) -> dict[str, DataFrame]:
    """G1 insights: one DataFrame per section."""
    return {"resumen": A.overall(df), "por_categoria": A.by_category(df), "periodo": A.period(df),
            "mensual": A.monthly(df), "top_gastos": A.top_n(df)}


def process_file(spark: SparkSession, path: str, file_type: str | None = None,
                 output_path: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """G1: load -> process -> insights (-> save)."""
    df = process_frame(load_data(spark, path, file_type, input_order=True))
    if output_path:
        save_processed(df, output_path)
    return df, insights(df)


def upload_job(spark: SparkSession, source: DataFrame | str, model: PipelineModel | str | None = None) -> dict[str, DataFrame]:
    """Read -> process -> predict with confidence -> KPI row + preview.

    ``source`` is a frame, or a file or folder; ``model`` a trained model or
    the folder of a saved one.  Without one the rules decide.
    """
    raw = load_data(spark, source, input_order=True) if isinstance(source, str) else source
    df = process_frame(raw).drop("categoria")
    if isinstance(model, str):
        model = load_model(model)
    df = predict_with_confidence(model, df, IMPROVED.method if model is not None else "rules").drop("feature_count")
    df = materialize(df.withColumnsRenamed({"categoria": "categoria_ia", "confidence": "confianza_ia"}))
    return {"datos": df, "kpis": A.kpis(df, cat="categoria_ia"), "preview": preview(df)}


def list_job(lists: DataFrame, base_date: dt.date, model: PipelineModel | None = None, auto: bool = True) -> DataFrame:
    """A10 -> D11: free-text lists to categorised transactions; with ``auto`` off every row is
    ``Sin categorizar`` with confidence 0.0."""
    rows = parse_quick_list(lists, base_date=base_date)
    if not auto:
        return rows.withColumn("categoria_ia", F.lit(UNCATEGORISED)).withColumn("confianza_ia", F.lit(0.0))
    done = predict_with_confidence(model, rows, IMPROVED.method if model is not None else "rules")
    return done.withColumnsRenamed({"categoria": "categoria_ia", "confidence": "confianza_ia"}).drop("method", "feature_count")


def full_job(spark: SparkSession, raw: DataFrame, out_dir: str | None = None,
             use_model: bool = True, model_path: str | None = None,
             as_of: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Process -> narrow types -> categorise (model or rules) -> anomalies -> report (-> save).

    The cleaned table is written once (checkpoint in the shared folder): the
    model fit and the anomaly statistics all read it, and a lost executor
    then costs a re-read, not a re-run of parsing and de-duplication.  The
    flagged table is written again because the report's sections read it.
    """
    processed = materialize(process_frame(raw, as_of).drop("categoria"))
    processed = narrow(processed)
    accuracy = None
    if use_model:
        categorized, accuracy = categorize_smart(processed, model_path=model_path)
    else:
        categorized = categorize_weighted(processed)
    flagged = materialize(detect_anomalies(materialize(categorized)))
    report = build_report(flagged, as_of=as_of, model_accuracy=accuracy)
    if out_dir:
        save_report_json(report, f"{out_dir}/reporte.json")
        save_processed(flagged, f"{out_dir}/gastos_procesados.csv")
    return {"datos": flagged, "reporte": report}
