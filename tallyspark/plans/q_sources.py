"""Registered queries: ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.constants import MERCHANT_CATALOGUE
from tallyspark.operators.schema import standardize_columns
from tallyspark.plans.oracle import BASE, DERIVED_PHRASES, sql_list, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import expenses, load
from tallyspark.sources import ingest as I
from tallyspark.sources.files import file_inventory

BASE_DATE = dt.date(2024, 1, 1)


@register("a5_file_inventory")
def a5(spark, sf):
    return file_inventory(spark, sf).select("name", "size", "size_mb", "extension", "is_supported")


@register("a6_standardize_columns", """
select o_orderkey, o_orderdate as monto, o_orderpriority as descripcion, o_totalprice as importe,
  o_orderstatus as tipo from orders""")
def a6(spark, sf):
    o = load(spark, sf, "orders")
    messy = o.select(F.col("o_orderkey").alias(" O_ORDERKEY "), F.col("o_orderdate").alias("Fecha Valor"),
                     F.col("o_orderpriority").alias("Merchant"), F.col("o_totalprice").alias(" IMPORTE "),
                     F.col("o_orderstatus").alias("Type"))
    out = standardize_columns(messy)
    return out


@register("a9_append_transactions", with_(*BASE) + """
select 'expenses' as origen, row_id as id, fecha, descripcion, monto from expenses
union all
select 'events', event_id, ts, event_type, value - 100 from events
where event_type is not null and length(trim(event_type)) > 0 and value - 100 > 0""")
def a9(spark, sf):
    base = expenses(spark, sf).select(F.lit("expenses").alias("origen"), F.col("row_id").alias("id"),
                                      "fecha", "descripcion", "monto")
    ev = load(spark, sf, "events")
    new = ev.select(F.lit("events").alias("origen"), F.col("event_id").alias("id"), F.col("ts").alias("fecha"),
                    F.col("event_type").alias("descripcion"), (F.col("value") - 100).alias("monto"))
    return I.append_transactions(base, new)


def quick_list_texts(spark, sf):
    """One free-text list per order, in one of four shapes (all rows used)."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    m = F.element_at(F.array(*[F.lit(p) for p in DERIVED_PHRASES]), (k % len(DERIVED_PHRASES)).cast("int") + 1)
    amt = F.round("o_totalprice").cast("bigint").cast("string")
    dotted = F.replace(F.format_number(F.round("o_totalprice"), 0), F.lit(","), F.lit("."))
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(k % 4 == 0, F.concat(d, F.lit(", "), m, F.lit(", "), amt))
             .when(k % 4 == 1, F.concat(m, F.lit(", "), amt))
             .when(k % 4 == 2, F.concat(F.lit("- "), m, F.lit(": $"), dotted))
             .otherwise(F.concat(m, F.lit(": "), amt, F.lit(" pesos\n   \n"), m, F.lit(" sin monto"))))
    return o.select(k.alias("list_id"), text.alias("texto"))


QUICK_SQL = f"""
with src as (
  select o_orderkey as list_id,
    case when o_orderkey % 4 = 0 then concat(strftime(o_orderdate, '%Y-%m-%d'), ', ', m, ', ', amt)
         when o_orderkey % 4 = 1 then concat(m, ', ', amt)
         when o_orderkey % 4 = 2 then concat('- ', m, ': $', replace(format('{{:,.0f}}', round(o_totalprice)), ',', '.'))
         else concat(m, ': ', amt, ' pesos' || chr(10) || '   ' || chr(10), m, ' sin monto') end as texto
  from (select *, ({sql_list(DERIVED_PHRASES)})[o_orderkey % {len(DERIVED_PHRASES)} + 1] as m,
          cast(cast(round(o_totalprice) as bigint) as varchar) as amt from orders) o),
lines as (
  select list_id, unnest(string_split(texto, chr(10))) as raw,
    unnest(range(1, len(string_split(texto, chr(10))) + 1)) as linea from src),
c as (
  select list_id, linea, trim(replace(replace(replace(trim(raw), '$', ''), '.', ''), 'pesos', '')) as c
  from lines where trim(raw) <> ''),
p as (
  select *, len(string_split(c, ',')) - 1 as nc, list_transform(string_split(c, ','), lambda x: trim(x)) as parts,
    string_split(c, ':') as colon from c),
r as (
  select list_id, linea,
    case when nc >= 2 and try_cast(parts[1] as timestamp) is not null and try_cast(parts[3] as double) is not null then 1
         when nc = 1 and try_cast(parts[2] as double) is not null then 2
         when contains(c, ':') and len(colon) = 2
              and length(array_to_string(regexp_extract_all(colon[2], '[0-9]+'), '')) > 0 then 3 end as fmt,
    parts, colon from p)
select list_id, cast(linea as integer) as linea,
  case when fmt = 1 then try_cast(parts[1] as timestamp) else timestamp '{BASE_DATE:%Y-%m-%d} 00:00:00' end as fecha,
  case fmt when 1 then parts[2] when 2 then parts[1] else trim(replace(colon[1], '-', '')) end as descripcion,
  case fmt when 1 then try_cast(parts[3] as double) when 2 then try_cast(parts[2] as double)
    else cast(array_to_string(regexp_extract_all(colon[2], '[0-9]+'), '') as double) end as monto
from r where fmt is not null"""


@register("a10_quick_list", QUICK_SQL)
def a10(spark, sf):
    return I.parse_quick_list(quick_list_texts(spark, sf), base_date=BASE_DATE)


def _synth_sql() -> str:
    n = len(MERCHANT_CATALOGUE)
    names = sql_list([m for m, _, _ in MERCHANT_CATALOGUE])
    cats = sql_list([c for _, c, _ in MERCHANT_CATALOGUE])
    lows = "[" + ", ".join(f"{float(r[0])}" for _, _, r in MERCHANT_CATALOGUE) + "]"
    highs = "[" + ", ".join(f"{float(r[1])}" for _, _, r in MERCHANT_CATALOGUE) + "]"
    lcg = "((({x}) % 2147483648) * 1103515245 + 12345) % 2147483648"
    x1 = lcg.format(x="o_orderkey")
    return f"""
with a as (select o_orderkey as id, {x1} as x1 from orders),
b as (select *, {lcg.format(x='x1')} as x2 from a),
c as (select *, {lcg.format(x='x2')} as x3, cast(floor(x1 / 65536) % {n} as integer) + 1 as idx from b)
select id, timestamp '2024-04-01 00:00:00' + to_days(cast(x3 % 91 as integer)) as fecha,
  ({names})[idx] as descripcion,
  round(({lows})[idx] + (({highs})[idx] - ({lows})[idx]) * (x2 / 2147483648.0), 2) as monto,
  ({cats})[idx] as categoria_ia,
  round(0.85 + 0.13 * (floor(x3 / 65536) % 10000) / 10000.0, 6) as confianza_ia
from c"""


@register("a11_synthetic_transactions", _synth_sql())
def a11(spark, sf):
    ids = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return I.synthesize(ids, as_of=dt.date(2024, 6, 30), period_days=90)
