"""Registered queries: cleaning and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.dates import calendar_columns, parse_date, weekday
from tallyspark.functions.money import clean_amount, parse_amount
from tallyspark.functions.text import clean_description, normalize_for_matching
from tallyspark.operators import clean as C
from tallyspark.plans.oracle import BASE, RAW, clean_desc_sql, norm_sql, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import expenses, expenses_raw, load


@register("b1_clean_description", with_(RAW) + f"""
select row_id, {clean_desc_sql('descripcion')} as descripcion from expenses_raw""")
def b1(spark, sf):
    return expenses_raw(spark, sf).select("row_id", clean_description(F.col("descripcion")).alias("descripcion"))


@register("b2_clean_amount", with_(RAW) + """
select row_id, case when isnan(m) then null else m end as monto from (
  select row_id, abs(try_cast(replace(replace(replace(monto, '$', ''), ',', '.'), ' ', '') as double)) as m
  from expenses_raw) t""")
def b2(spark, sf):
    return expenses_raw(spark, sf).select("row_id", clean_amount(F.col("monto")).alias("monto"))


@register("b3_parse_date", with_(RAW) + """
select row_id, try_cast(fecha as timestamp) as fecha from expenses_raw""")
def b3(spark, sf):
    return expenses_raw(spark, sf).select("row_id", parse_date(F.col("fecha")).alias("fecha"))


@register("b3_slash_dates", """
select o_orderkey as row_id,
  case when o_orderkey % 3 = 1 and day(o_orderdate) <= 12
       then make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0)
       else cast(o_orderdate as timestamp) end as fecha,
  case when o_orderkey % 3 = 0 and day(o_orderdate) <= 12
       then make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0.0)
       else cast(o_orderdate as timestamp) end as fecha_dia_primero
from orders""")
def b3_slash(spark, sf):
    """Month first, day first and year first texts, read in both orders."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    text = (F.when(k == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
             .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")))
    return o.select(F.col("o_orderkey").alias("row_id"), parse_date(text).alias("fecha"),
                    parse_date(text, day_first=True).alias("fecha_dia_primero"))


@register("b4_valid_rows", with_(*BASE[:3]) + "select row_id, fecha, descripcion, monto from valid")
def b4(spark, sf):
    df = expenses_raw(spark, sf)
    df = C.parse_dates(C.clean_amounts(C.clean_descriptions(df)))
    return C.drop_invalid(df).select("row_id", "fecha", "descripcion", "monto")


@register("b5_clean_expenses", with_(*BASE) + "select * from expenses")
def b5(spark, sf):
    return expenses(spark, sf)


@register("b6_normalize_text", with_(RAW) + f"""
select row_id, {norm_sql('descripcion')} as texto from expenses_raw""")
def b6(spark, sf):
    return expenses_raw(spark, sf).select(
        "row_id", normalize_for_matching(F.col("descripcion")).alias("texto"))


@register("b6_normalize_conversations", f"""
select conv_id, turn, {norm_sql('text')} as texto from conversations""")
def b6_conv(spark, sf):
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", normalize_for_matching(F.col("text")).alias("texto"))


@register("b7_calendar", with_(*BASE) + """
select row_id, fecha, descripcion, monto,
  cast(year(fecha) as integer) as "año", cast(month(fecha) as integer) as mes,
  cast(day(fecha) as integer) as dia, cast(isodow(fecha) - 1 as integer) as dia_semana,
  strftime(fecha, '%A') as dia_semana_nombre, strftime(fecha, '%B') as mes_nombre,
  cast(quarter(fecha) as integer) as trimestre,
  coalesce(isodow(fecha) in (6, 7), false) as es_fin_semana
from expenses""")
def b7(spark, sf):
    df = expenses(spark, sf)
    return df.select("*", *[c.alias(n) for n, c in calendar_columns(F.col("fecha")).items()])


@register("b8_hour_weekday", """
select event_id, cast(hour(ts) as integer) as hora, cast(isodow(ts) - 1 as integer) as dia_semana
from events""")
def b8(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select("event_id", F.hour("ts").alias("hora"), weekday(F.col("ts")).alias("dia_semana"))


@register("b9_parse_amount", with_(RAW) + """
select row_id, coalesce(case when isnan(m) then null else m end, 0.0) as monto from (
  select row_id, try_cast(replace(replace(trim(replace(monto, '$', '')), ',', ''), ' ', '') as double) as m
  from expenses_raw) t""")
def b9(spark, sf):
    return expenses_raw(spark, sf).select("row_id", parse_amount(F.col("monto")).alias("monto"))
