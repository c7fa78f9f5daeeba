"""The full report (E14) as one nested row plus flat sections.

Each section is a separate aggregation whose result is bounded by the
number of categories / methods / top rows; the sections are combined
by cross-joining one-row frames, so no stage ever sees more than a
handful of rows after the aggregations.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.constants import CONF_HIGH, CONF_LOW, REPORT_VERSION, TOP_REPORT, UNCATEGORISED


def _flag(df: DataFrame, name: str):
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def summary_section(df: DataFrame) -> DataFrame:
    """Totals, period, category count, mean confidence, bands, anomalies by method."""
    conf = F.col("confidence")
    return df.agg(
        F.count(F.lit(1)).alias("total_gastos"),
        F.round(F.sum("monto"), 2).alias("monto_total"),
        F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"),
        F.count_distinct("categoria").alias("categorias_detectadas"),
        F.round(F.avg(conf), 6).alias("confianza_promedio"),
        F.count_if(conf > CONF_HIGH).alias("alta_confianza"),
        F.count_if((conf >= CONF_LOW) & (conf <= CONF_HIGH)).alias("media_confianza"),
        F.count_if(conf < CONF_LOW).alias("baja_confianza"),
        F.count_if(_flag(df, "is_any_anomaly")).alias("total_detectadas"),
        F.count_if(_flag(df, "is_ml_anomaly")).alias("ml_anomalies"),
        F.count_if(_flag(df, "is_category_anomaly")).alias("category_anomalies"),
        F.count_if(_flag(df, "is_anomaly")).alias("statistical_anomalies"))


def methods_section(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(F.count(F.lit(1)).alias("count"))


def categories_section(df: DataFrame) -> DataFrame:
    """Per category: count, total, mean, mean confidence, anomalies and % share."""
    per = df.groupBy("categoria").agg(
        F.count(F.lit(1)).alias("cantidad"), F.sum("monto").alias("_t"),
        F.avg("monto").alias("_m"), F.avg("confidence").alias("_c"),
        F.count_if(_flag(df, "is_any_anomaly")).alias("anomalias"))
    grand = df.agg(F.sum("monto").alias("_grand"))  # one row
    return per.crossJoin(F.broadcast(grand)).select("categoria", "cantidad", F.round("_t", 2).alias("total"), F.round("_m", 2).alias("promedio"),
                      F.round("_c", 6).alias("confianza_promedio"), "anomalias",
                      F.round(F.col("_t") / F.col("_grand") * 100, 6).alias("porcentaje"))


def top_section(df: DataFrame, n: int = TOP_REPORT, order_col: str = "row_id") -> DataFrame:
    return (df.orderBy(F.col("monto").desc(), F.col(order_col).asc()).limit(n)
              .select(order_col, "descripcion", "monto", "categoria", F.round("confidence", 6).alias("confidence"),
                      "method", _flag(df, "is_any_anomaly").alias("is_anomaly")))


def build_report(df: DataFrame, as_of: dt.datetime | None = None,
                 model_accuracy: float | None = None) -> DataFrame:
    """One nested row (written as JSON by ``sinks.save_report_json``).

    The sections read ``df`` several times: give it materialised.  A missing
    category or method is reported under ``Sin categorizar``.
    """
    stamp = (as_of or dt.datetime.now()).isoformat()
    s = summary_section(df)
    m = methods_section(df).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("method", F.lit(UNCATEGORISED)), "count"))).alias("metodos"))
    c = categories_section(df).agg(F.map_from_entries(F.collect_list(F.struct(
        F.coalesce("categoria", F.lit(UNCATEGORISED)), F.struct("cantidad", "total", "promedio", "confianza_promedio", "anomalias",
                              "porcentaje")))).alias("categorias_detalladas"))
    # sort key (amount desc, input order asc) rides in front and is dropped after sorting
    t = top_section(df).agg(F.sort_array(F.collect_list(F.struct(
        F.col("monto").alias("_k1"), (-F.col("row_id")).alias("_k2"), "descripcion", "monto", "categoria",
        "confidence", "method", "is_anomaly")), asc=False).alias("_top"))
    t = t.select(F.transform("_top", lambda x: x.dropFields("_k1", "_k2")).alias("top_gastos"))
    one = s.crossJoin(m).crossJoin(c).crossJoin(t)
    return one.select(
        F.lit(stamp).alias("fecha_reporte"), F.lit(REPORT_VERSION).alias("version_sistema"),
        F.struct("total_gastos", "monto_total",
                 F.struct(F.col("desde").cast("string").alias("desde"),
                          F.col("hasta").cast("string").alias("hasta")).alias("periodo"),
                 F.lit(True).alias("optimizaciones_aplicadas")).alias("datos_procesados"),
        F.struct("categorias_detectadas", "confianza_promedio", F.col("metodos").alias("metodos_utilizados"),
                 F.struct("alta_confianza", "media_confianza", "baja_confianza").alias("distribuciones_confianza"))
         .alias("categorizacion"),
        F.struct("total_detectadas", F.struct("ml_anomalies", "category_anomalies", "statistical_anomalies")
                 .alias("por_metodo")).alias("anomalias"),
        "categorias_detalladas", "top_gastos",
        F.lit(model_accuracy).cast("double").alias("modelo_accuracy"))
