"""Registered queries: formatting, presentation and quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.constants import AUTO_CHOICE, CATEGORY_STYLE, CONF_HIGH_ALT, CONF_LOW_ALT
from tallyspark.functions.dates import date_range_label, period_name, preset_ranges
from tallyspark.functions.money import format_amount, format_amount_short
from tallyspark.operators import present as P
from tallyspark.operators import quality as Q
from tallyspark.operators.analytics import category_share
from tallyspark.plans.oracle import BASE, CAT_BASE, FRULES, RAW, first_match_cte, q, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized, expenses, expenses_raw, load

AS_OF = dt.datetime(2000, 6, 30, 12, 0, 0)


def fmt_sql(x: str, d: int) -> str:
    return f"format('{{:,.{d}f}}', {x})"


@register("b10_format_amount", with_(*BASE) + f"""
select row_id, case when monto is null or isnan(monto) then '$0.00' else concat('$', {fmt_sql('monto', 2)}) end
  as monto_fmt from expenses""")
def b10(spark, sf):
    return expenses(spark, sf).select("row_id", format_amount(F.col("monto")).alias("monto_fmt"))


def _short_sql(x: str) -> str:
    return (f"case when {x} is null or isnan({x}) then '$0' "
            f"when {x} >= 1000000 then concat('$', replace({fmt_sql(x + ' / 1000000', 1)}, ',', ''), 'M') "
            f"when {x} >= 1000 then concat('$', replace({fmt_sql(x + ' / 1000', 1)}, ',', ''), 'K') "
            f"else concat('$', replace({fmt_sql(x, 0)}, ',', '')) end")


@register("b11_format_short", with_(*BASE) + f"""
select row_id, {_short_sql('monto')} as monto_corto from expenses""")
def b11(spark, sf):
    return expenses(spark, sf).select("row_id", format_amount_short(F.col("monto")).alias("monto_corto"))


@register("b11_format_short_totals", with_(*CAT_BASE) + f"""
, s as (select categoria, round(sum(monto), 2) as monto from cat group by categoria)
select categoria, {_short_sql('monto')} as total_corto from s""")
def b11_tot(spark, sf):
    return category_share(categorized(spark, sf)).select(
        "categoria", format_amount_short(F.col("monto")).alias("total_corto"))


@register("b12_period_name", with_(*BASE) + """
select row_id, strftime(fecha, '%b %Y') as periodo from expenses""")
def b12(spark, sf):
    return expenses(spark, sf).select("row_id", period_name(F.col("fecha")).alias("periodo"))


def _label_sql(a: str, b: str) -> str:
    return (f"case when year({a}) = year({b}) and month({a}) = month({b}) then "
            f"concat(cast(day({a}) as varchar), '-', cast(day({b}) as varchar), ' ', strftime({a}, '%B %Y')) "
            f"when year({a}) = year({b}) then concat(strftime({a}, '%B'), ' - ', strftime({b}, '%B %Y')) "
            f"else concat(strftime({a}, '%B %Y'), ' - ', strftime({b}, '%B %Y')) end")


@register("b13_date_range_label", with_(*CAT_BASE) + f"""
, g as (
  select 'categoria' as grupo, categoria as clave, min(fecha) as a, max(fecha) as b from cat group by categoria
  union all
  select 'anio', cast(year(fecha) as varchar), min(fecha), max(fecha) from cat where fecha is not null group by 2
  union all
  select 'mes', strftime(fecha, '%Y-%m'), min(fecha), max(fecha) from cat where fecha is not null group by 2)
select grupo, clave, {_label_sql('a', 'b')} as etiqueta from g""")
def b13(spark, sf):
    df = categorized(spark, sf)
    dated = df.where(F.col("fecha").isNotNull())
    by = [df.groupBy(F.lit("categoria").alias("grupo"), F.col("categoria").alias("clave")),
          dated.groupBy(F.lit("anio").alias("grupo"), F.year("fecha").cast("string").alias("clave")),
          dated.groupBy(F.lit("mes").alias("grupo"), F.date_format("fecha", "yyyy-MM").alias("clave"))]
    parts = [g.agg(F.min("fecha").alias("a"), F.max("fecha").alias("b")) for g in by]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("grupo", "clave", date_range_label(F.col("a"), F.col("b")).alias("etiqueta"))


@register("b14_filter", with_(*CAT_BASE) + """
select row_id, fecha, descripcion, monto, categoria from cat
where categoria in ('Salud', 'Hogar') and fecha between timestamp '1996-01-01' and timestamp '1998-12-31'
  and monto between 1000 and 20000""")
def b14(spark, sf):
    out = P.filter_expenses(categorized(spark, sf), categories=["Salud", "Hogar"],
                            start=dt.datetime(1996, 1, 1), end=dt.datetime(1998, 12, 31),
                            min_amount=1000, max_amount=20000)
    return out.select("row_id", "fecha", "descripcion", "monto", "categoria")


def _presets_sql() -> str:
    rows = " union all ".join(
        f"select {q(n)} as preset, timestamp '{s:%Y-%m-%d %H:%M:%S}' as desde, timestamp '{e:%Y-%m-%d %H:%M:%S}' as hasta"
        for n, s, e in preset_ranges(AS_OF))
    return with_(*BASE) + f""", p as ({rows})
select p.preset, p.desde, p.hasta, count(x.monto) as n, round(coalesce(sum(x.monto), 0.0), 2) as total
from p left join expenses x on x.fecha between p.desde and p.hasta group by 1, 2, 3"""


@register("b15_preset_ranges", _presets_sql())
def b15(spark, sf):
    return P.preset_totals(expenses(spark, sf), AS_OF)


@register("b16_confidence_bands", with_(*CAT_BASE) + """
select 'report' as bandas, case when confidence > 0.8 then 'alta' when confidence < 0.5 then 'baja' else 'media' end
  as banda, count(*) as n from cat group by 1, 2
union all
select 'demo', case when confidence > 0.7 then 'alta' when confidence < 0.4 then 'baja' else 'media' end,
  count(*) from cat group by 1, 2""")
def b16(spark, sf):
    df = categorized(spark, sf)
    a = df.groupBy(F.lit("report").alias("bandas"), P.confidence_band(F.col("confidence")).alias("banda")).agg(
        F.count(F.lit(1)).alias("n"))
    b = df.groupBy(F.lit("demo").alias("bandas"),
                   P.confidence_band(F.col("confidence"), CONF_HIGH_ALT, CONF_LOW_ALT).alias("banda")).agg(
        F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def _manual_spark(df):
    """Manual choices: icon + first-match category, the category alone, blank, and none."""
    from tallyspark.operators.rules import categorize_first_match
    icons = F.create_map(*[x for c, _, i in CATEGORY_STYLE for x in (F.lit(c), F.lit(i))])
    fm = F.col("_fm")
    k = F.col("row_id") % 5
    manual = (F.when(k == 0, F.concat(icons[fm], F.lit(" "), fm)).when(k == 1, fm).when(k == 2, F.lit("  "))
               .when(k == 3, F.lit(AUTO_CHOICE)))
    return categorize_first_match(df, "_fm").withColumn("categoria_manual", manual).drop("_fm")


@register("b17_manual_override", with_(*CAT_BASE, FRULES, first_match_cte("expenses", name="fmx")) + """
select row_id, case when row_id % 5 <= 1 then fm.categoria else cat.categoria end as categoria_ia,
  round(case when row_id % 5 <= 1 then 1.0 else confidence end, 6) as confianza_ia
from cat join fmx fm on cat.descripcion = fm.t""")
def b17(spark, sf):
    out = P.apply_manual_category(_manual_spark(expenses(spark, sf)))
    return out.select("row_id", "categoria_ia", F.round("confianza_ia", 6).alias("confianza_ia"))


@register("b18_category_style", with_(*CAT_BASE) + """
, style(categoria, color, icon) as (values """ + ", ".join(f"({q(c)}, {q(co)}, {q(i)})" for c, co, i in CATEGORY_STYLE) + """)
select row_id, categoria, color, icon from cat left join style using (categoria)""")
def b18(spark, sf):
    return P.with_style(categorized(spark, sf)).select("row_id", "categoria", "color", "icon")


@register("b19_preview", with_(*CAT_BASE) + """
select row_id, fecha, descripcion, monto, categoria as categoria_ia, round(confidence, 6) as confianza_ia
from cat order by row_id limit 10""")
def b19(spark, sf):
    df = categorized(spark, sf).select("row_id", "fecha", "descripcion", "monto",
                                       F.col("categoria").alias("categoria_ia"),
                                       F.round("confidence", 6).alias("confianza_ia"))
    return P.preview(df)


@register("b20_display_columns", with_(*CAT_BASE) + f"""
select row_id, strftime(fecha, '%Y-%m-%d') as fecha, descripcion, concat('$', {fmt_sql('monto', 2)}) as monto,
  categoria as categoria_ia, concat({fmt_sql('confidence * 100', 1)}, '%') as confianza_ia from cat""")
def b20(spark, sf):
    df = categorized(spark, sf).select("row_id", "fecha", "descripcion", "monto",
                                       F.col("categoria").alias("categoria_ia"),
                                       F.col("confidence").alias("confianza_ia"))
    return P.display_columns(df)


def _narrow_sql() -> str:
    ints = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}
    floats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    texts = ["l_returnflag", "l_linestatus"]
    parts = []
    for c, src in ints.items():
        parts.append(f"""select '{c}' as "column", '{src}' as source_type, case
          when min({c}) >= -128 and max({c}) <= 127 then 'tinyint'
          when min({c}) >= -32768 and max({c}) <= 32767 then 'smallint'
          when min({c}) >= -2147483648 and max({c}) <= 2147483647 then 'int' else 'bigint' end as chosen_type
          from lineitem""")
    for c in floats:
        parts.append(f"""select '{c}', 'double', case when count(*) filter
          (where abs(cast(cast({c} as float) as double) - {c}) > 1e-8) = 0 then 'float' else 'double' end from lineitem""")
    for c in texts:
        parts.append(f"""select '{c}', 'string', case when count(distinct {c}) / count(*) < 0.5
          then 'category' else 'string' end from lineitem""")
    parts.append("select 'l_shipdate', 'timestamp_ntz', 'timestamp_ntz'")
    return "\nunion all\n".join(parts)


@register("b21_narrowing_plan", _narrow_sql())
def b21(spark, sf):
    return Q.narrowing_plan(load(spark, sf, "lineitem"))


@register("e12_data_quality", with_(RAW) + """
, t as (select row_id, try_cast(fecha as timestamp) as fecha, descripcion,
          try_cast(trim(monto) as double) as monto, monto as monto_raw, fecha as fecha_raw from expenses_raw),
c as (select count(*) as row_count, count(*) filter (where descripcion is null) as empty_descriptions,
        count(*) filter (where monto is null or isnan(monto)) as invalid_amounts,
        count(*) filter (where monto < 0) as negative_amounts, count(*) filter (where monto = 0) as zero_amounts,
        count(*) filter (where fecha is null) as invalid_dates,
        count(*) - (select count(*) from (select distinct fecha, descripcion, monto from t) d) as duplicate_rows
      from t)
select true as valid, row_count, empty_descriptions, invalid_amounts, negative_amounts, zero_amounts,
  invalid_dates, duplicate_rows,
  greatest(0, 100 - 5 * ((empty_descriptions > 0)::int + (invalid_amounts > 0)::int + (negative_amounts > 0)::int
    + (zero_amounts > 0)::int + (invalid_dates > 0)::int + (duplicate_rows > 0)::int)) as data_quality_score
from c""")
def e12(spark, sf):
    out = Q.validate(Q.typed_view(expenses_raw(spark, sf)))
    return out.drop("issues", "warnings")


@register("e12_data_quality_messages", with_(RAW) + """
, t as (select try_cast(fecha as timestamp) as fecha, descripcion, try_cast(trim(monto) as double) as monto
        from expenses_raw),
c as (select count(*) filter (where descripcion is null) as a, count(*) filter (where monto is null) as b,
        count(*) filter (where monto < 0) as c1, count(*) filter (where monto = 0) as d,
        count(*) filter (where fecha is null) as e,
        count(*) - (select count(*) from (select distinct fecha, descripcion, monto from t) x) as f from t)
select concat_ws(' | ',
  case when a > 0 then 'Descripciones vacías: ' || a end, case when b > 0 then 'Montos inválidos: ' || b end,
  case when c1 > 0 then 'Montos negativos: ' || c1 end, case when d > 0 then 'Montos en cero: ' || d end,
  case when e > 0 then 'Fechas inválidas: ' || e end, case when f > 0 then 'Registros duplicados: ' || f end)
  as warnings from c""")
def e12_msgs(spark, sf):
    out = Q.validate(Q.typed_view(expenses_raw(spark, sf)))
    return out.select(F.array_join("warnings", " | ").alias("warnings"))
