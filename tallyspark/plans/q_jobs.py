"""Registered queries: report sections (E14) and end-to-end jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import report as Rp
from tallyspark.plans import jobs as P
from tallyspark.plans.oracle import BASE, CAT_BASE, FRULES, WRULES, first_match_cte, weighted_cte, with_
from tallyspark.plans.q_anomaly import FLAGS
from tallyspark.plans.registry import register
from tallyspark.plans.q_sources import QUICK_SQL, quick_list_texts, BASE_DATE
from tallyspark.plans.views import categorized, expenses_raw, flagged_once
from tallyspark.session import materialize

AS_OF = dt.datetime(2001, 9, 1)


@register("e14_report_summary", FLAGS + """
select count(*) as total_gastos, round(sum(monto), 2) as monto_total, min(fecha) as desde, max(fecha) as hasta,
  count(distinct categoria) as categorias_detectadas, round(avg(confidence), 6) as confianza_promedio,
  count(*) filter (where confidence > 0.8) as alta_confianza,
  count(*) filter (where confidence >= 0.5 and confidence <= 0.8) as media_confianza,
  count(*) filter (where confidence < 0.5) as baja_confianza,
  count(*) filter (where is_anomaly or is_category_anomaly) as total_detectadas,
  cast(0 as bigint) as ml_anomalies,
  count(*) filter (where is_category_anomaly) as category_anomalies,
  count(*) filter (where is_anomaly) as statistical_anomalies
from flags""")
def e14_summary(spark, sf):
    return Rp.summary_section(flagged_once(spark, sf))


@register("e14_report_categories", FLAGS + """
, per as (select categoria, count(*) as cantidad, sum(monto) as t, avg(monto) as m, avg(confidence) as c,
            count(*) filter (where is_anomaly or is_category_anomaly) as anomalias from flags group by categoria)
select categoria, cantidad, round(t, 2) as total, round(m, 2) as promedio, round(c, 6) as confianza_promedio,
  anomalias, round(t / sum(t) over () * 100, 6) as porcentaje from per""")
def e14_categories(spark, sf):
    return Rp.categories_section(flagged_once(spark, sf))


@register("e14_report_methods", with_(*CAT_BASE) + "select method, count(*) as count from cat group by method")
def e14_methods(spark, sf):
    return Rp.methods_section(categorized(spark, sf))


@register("e14_report_top", FLAGS + """
select row_id, descripcion, monto, categoria, round(confidence, 6) as confidence, method,
  is_anomaly or is_category_anomaly as is_anomaly
from flags order by monto desc, row_id limit 5""")
def e14_top(spark, sf):
    return Rp.top_section(flagged_once(spark, sf))


@register("e14_report_nested")
def e14_nested(spark, sf):
    return Rp.build_report(flagged_once(spark, sf), as_of=AS_OF)


G1_SQL = with_(*BASE, FRULES, first_match_cte("expenses", name="fmx")) + """
select e.row_id, e.fecha, e.descripcion, e.monto, f.categoria,
  cast(year(fecha) as integer) as "año", cast(month(fecha) as integer) as mes,
  cast(day(fecha) as integer) as dia, cast(isodow(fecha) - 1 as integer) as dia_semana,
  strftime(fecha, '%A') as dia_semana_nombre, strftime(fecha, '%B') as mes_nombre,
  cast(quarter(fecha) as integer) as trimestre, coalesce(isodow(fecha) in (6, 7), false) as es_fin_semana
from expenses e join fmx f on e.descripcion = f.t"""


@register("g1_process_file", G1_SQL)
def g1(spark, sf):
    return P.process_frame(expenses_raw(spark, sf), as_of=AS_OF)


@register("g1_insights_by_category", with_(*BASE, FRULES, first_match_cte("expenses", name="fmx")) + """
select f.categoria, round(sum(monto), 2) as "sum", count(*) as "count", round(avg(monto), 2) as "mean"
from expenses e join fmx f on e.descripcion = f.t group by f.categoria""")
def g1_ins(spark, sf):
    df = P.process_frame(expenses_raw(spark, sf), as_of=AS_OF)
    return P.insights(df)["por_categoria"]


@register("g3_upload_kpis", with_(*CAT_BASE) + """
select count(*) as transacciones, round(sum(monto), 2) as total, round(avg(monto), 2) as promedio,
  count(distinct categoria) as categorias from cat""")
def g3_kpis(spark, sf):
    return P.upload_job(spark, expenses_raw(spark, sf))["kpis"]


@register("g3_upload_preview", with_(*CAT_BASE) + """
select row_id, fecha, descripcion, monto, categoria as categoria_ia, round(confidence, 6) as confianza_ia
from cat order by row_id limit 10""")
def g3_preview(spark, sf):
    out = P.upload_job(spark, expenses_raw(spark, sf))["preview"]
    return out.withColumn("confianza_ia", F.round("confianza_ia", 6))


@register("g2_full_job")
def g2(spark, sf):
    return P.full_job(spark, expenses_raw(spark, sf), as_of=AS_OF)["reporte"]


FLAT_SQL = """
select count(*) as total_gastos, round(sum(monto), 2) as monto_total,
  strftime(min(fecha), '%Y-%m-%d %H:%M:%S') as desde, strftime(max(fecha), '%Y-%m-%d %H:%M:%S') as hasta,
  count(distinct categoria) as categorias, count(distinct categoria) as categorias_detalladas,
  round(avg(confidence), 6) as confianza, count(*) filter (where confidence > 0.8) as alta,
  count(*) filter (where is_anomaly or is_category_anomaly) as anomalias,
  round(sum(monto), 2) as total_por_categoria, 5 as top, max(monto) as mayor
from flags"""


def flat_report(report):
    """The nested report as one flat row."""
    detail = F.map_values("categorias_detalladas") if "map<" in report.schema["categorias_detalladas"].dataType.simpleString() \
        else F.array(*[F.col(f"categorias_detalladas.`{c}`") for c in report.schema["categorias_detalladas"].dataType.names])
    total = F.aggregate(detail, F.lit(0.0), lambda s, x: s + x["total"])
    return report.select(
        "datos_procesados.total_gastos", "datos_procesados.monto_total", "datos_procesados.periodo.desde", "datos_procesados.periodo.hasta",
        F.col("categorizacion.categorias_detectadas").alias("categorias"), F.size(detail).cast("bigint").alias("categorias_detalladas"),
        F.col("categorizacion.confianza_promedio").alias("confianza"), F.col("categorizacion.distribuciones_confianza.alta_confianza").alias("alta"),
        F.col("anomalias.total_detectadas").alias("anomalias"), F.round(total, 2).alias("total_por_categoria"),
        F.size("top_gastos").alias("top"), F.col("top_gastos")[0]["monto"].alias("mayor"))


@register("e14_report_nested_flat", FLAGS + FLAT_SQL)
def e14_flat(spark, sf):
    return flat_report(Rp.build_report(flagged_once(spark, sf), as_of=AS_OF))


@register("g2_full_job_saved", with_(*BASE) + """
select count(*) as total_gastos, round(sum(monto), 2) as monto_total, count(*) as filas_guardadas,
  round(sum(monto), 2) as monto_guardado, 0::bigint as sin_categoria, true as confianza_valida
from expenses""")
def g2_saved(spark, sf):
    """G2 with the model: the saved report and table read back; predictions are checked, not compared."""
    from tallyspark.plans.q_files import drop_folder, scratch
    out = scratch(spark, "g2")
    P.full_job(spark, expenses_raw(spark, sf), out_dir=out, as_of=AS_OF)
    report = spark.read.json(f"{out}/reporte.json").select("datos_procesados.total_gastos", "datos_procesados.monto_total")
    saved = spark.read.option("header", True).csv(f"{out}/gastos_procesados.csv")
    confidence = F.col("confidence").cast("double")
    table = saved.agg(F.count(F.lit(1)).alias("filas_guardadas"), F.round(F.sum(F.col("monto").cast("double")), 2).alias("monto_guardado"),
                      F.count_if(F.col("categoria").isNull()).alias("sin_categoria"), F.min((confidence > 0) & (confidence <= 1)).alias("confianza_valida"))
    done = materialize(report.crossJoin(table))
    drop_folder(spark, out)
    return done


@register("g3_upload_folder_kpis", with_(*CAT_BASE) + """
select count(*) as transacciones, round(sum(monto), 2) as total, round(avg(monto), 2) as promedio,
  count(distinct categoria) as categorias from cat""")
def g3_folder(spark, sf):
    """G3 from a folder of CSV files."""
    from tallyspark.plans.q_files import drop_folder, scratch
    path = scratch(spark, "g3") + ".csv"
    expenses_raw(spark, sf).write.option("header", True).csv(path)
    done = materialize(P.upload_job(spark, path)["kpis"])
    drop_folder(spark, path)
    return done


@register("g3_upload_model_checks", with_(*BASE) + """
select count(*) as filas, 0::bigint as sin_categoria, true as confianza_valida, 'ml_improved' as method from expenses""")
def g3_model(spark, sf):
    """G3 with a learned model."""
    from tallyspark.ml import categorizer as M
    raw = expenses_raw(spark, sf)
    res = M.train(materialize(P.process_frame(raw).drop("categoria")), cfg=M.IMPROVED)
    c = F.col("confianza_ia")
    return P.upload_job(spark, raw, res.model)["datos"].agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("categoria_ia").isNull()).alias("sin_categoria"),
        F.min((c > 0) & (c <= 1.0000001)).alias("confianza_valida"), F.max("method").alias("method"))


@register("a10_list_categorised", "with lista as (" + QUICK_SQL + "),\n" + WRULES + ",\n" + weighted_cte("lista") + """
select l.list_id, l.linea, l.fecha, l.descripcion, l.monto, s.categoria as categoria_ia,
  round(case when s.s10 > 0 then least(s.s10 / 50.0, 1.0) else 0.1 end, 6) as confianza_ia
from lista l join scored s on l.descripcion = s.t""")
def a10_list(spark, sf):
    return P.list_job(quick_list_texts(spark, sf), BASE_DATE).withColumn("confianza_ia", F.round("confianza_ia", 6))
