"""Registered queries: aggregations and summaries."""

from __future__ import annotations


from tallyspark.operators import analytics as A
from tallyspark.constants import ADVICE_LARGE, ADVICE_MANY_CATEGORIES
from tallyspark.plans.oracle import BASE, CAT_BASE, q, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized, expenses, load


def money_sql(x: str, d: int = 2) -> str:
    return f"case when {x} is null or isnan({x}) then '$0.00' else concat('$', format('{{:,.{d}f}}', {x})) end"


@register("e1_overall", with_(*BASE) + """
select count(*) as total_gastos, round(sum(monto), 2) as monto_total, round(avg(monto), 2) as monto_promedio,
  round(median(monto), 2) as monto_mediano from expenses""")
def e1(spark, sf):
    return A.overall(expenses(spark, sf))


@register("e2_by_category", with_(*CAT_BASE) + """
select categoria, round(sum(monto), 2) as "sum", count(*) as "count", round(avg(monto), 2) as "mean"
from cat group by categoria""")
def e2(spark, sf):
    return A.by_category(categorized(spark, sf))


@register("e2_lineitem_by_flag", """
select l_returnflag as categoria, round(sum(l_extendedprice), 2) as "sum", count(*) as "count",
  round(avg(l_extendedprice), 2) as "mean" from lineitem group by l_returnflag""")
def e2_li(spark, sf):
    return A.by_category(load(spark, sf, "lineitem"), cat="l_returnflag", amount="l_extendedprice")


@register("e3_period", with_(*BASE) + """
select min(fecha) as fecha_inicio, max(fecha) as fecha_fin,
  cast(floor((epoch_us(max(fecha)) - epoch_us(min(fecha))) / 86400000000.0) as bigint) as dias_total
from expenses""")
def e3(spark, sf):
    return A.period(expenses(spark, sf))


@register("e4_monthly", with_(*BASE) + """
select cast(year(fecha) as integer) as "año", cast(month(fecha) as integer) as mes, round(sum(monto), 2) as monto
from expenses where fecha is not null group by 1, 2""")
def e4(spark, sf):
    return A.monthly(expenses(spark, sf))


@register("e5_top_expenses", with_(*CAT_BASE) + """
select row_id, descripcion, monto, categoria from cat order by monto desc, row_id limit 10""")
def e5(spark, sf):
    return A.top_n(categorized(spark, sf))


@register("e6_daily", with_(*BASE) + """
select cast(fecha as date) as fecha, round(sum(monto), 2) as monto
from expenses where fecha is not null group by 1""")
def e6(spark, sf):
    return A.daily(expenses(spark, sf))


@register("e7_trend", with_(*BASE) + """
, c as (select max(fecha) - interval 30 day as cutoff from expenses),
s as (select coalesce(sum(monto) filter (where fecha > cutoff), 0.0) as recent,
             coalesce(sum(monto) filter (where fecha <= cutoff), 0.0) as previous from expenses, c)
select round(recent, 2) as recent_total, round(previous, 2) as previous_total,
  round(case when previous > 0 then (recent - previous) / previous * 100 else 0.0 end, 6) as trend_percentage
from s""")
def e7(spark, sf):
    return A.trend(expenses(spark, sf))


@register("e8_category_insights", with_(*CAT_BASE) + """
, st as (select categoria, sum(monto) as t, count(*) as transaction_count, avg(monto) as a from cat group by categoria),
st2 as (select categoria, round(t, 2) as total_amount, transaction_count, round(a, 2) as average_amount,
          round(t / sum(t) over () * 100, 6) as percentage_of_total from st),
tp as (select categoria, top_rank, descripcion as top_descripcion, monto as top_monto from (
         select *, row_number() over (partition by categoria order by monto desc, row_id) as top_rank from cat) z
       where top_rank <= 3)
select st2.*, tp.top_rank, tp.top_descripcion, tp.top_monto from st2 join tp using (categoria)""")
def e8(spark, sf):
    return A.category_insights(categorized(spark, sf))


@register("e9_summary_stats", with_(*BASE) + f"""
, s as (select count(*) as total_transactions, round(sum(monto), 2) as total_amount,
          round(avg(monto), 2) as average_transaction, round(median(monto), 2) as median_transaction,
          max(monto) as max_transaction, min(monto) as min_transaction,
          round(stddev_samp(monto), 2) as std_transaction from expenses)
select *, {money_sql('total_amount')} as total_amount_formatted,
  {money_sql('average_transaction')} as average_transaction_formatted,
  {money_sql('median_transaction')} as median_transaction_formatted,
  {money_sql('max_transaction')} as max_transaction_formatted,
  {money_sql('min_transaction')} as min_transaction_formatted
from s""")
def e9(spark, sf):
    return A.summary_stats(expenses(spark, sf))


@register("e10_category_share", with_(*CAT_BASE) + """
select categoria, round(sum(monto), 2) as monto from cat group by categoria""")
def e10(spark, sf):
    return A.category_share(categorized(spark, sf))


@register("e11_category_table", with_(*CAT_BASE) + """
select categoria, round_even(sum(monto), 2) as "Total", count(*) as "Cantidad",
  round_even(avg(monto), 2) as "Promedio" from cat group by categoria order by "Total" """)
def e11(spark, sf):
    return A.category_table(categorized(spark, sf))


@register("e13_kpis", with_(*CAT_BASE) + """
select count(*) as transacciones, round(sum(monto), 2) as total, round(avg(monto), 2) as promedio,
  count(distinct categoria) as categorias from cat""")
def e13(spark, sf):
    return A.kpis(categorized(spark, sf))


@register("e15_value_counts_category", with_(*CAT_BASE) + """
select categoria as value, count(*) as count from cat where categoria is not null group by 1 order by 2 desc""")
def e15(spark, sf):
    return A.value_counts(categorized(spark, sf), "categoria")


@register("e15_value_counts_lineitem", """
select l_linestatus as value, count(*) as count from lineitem where l_linestatus is not null
group by 1 order by 2 desc""")
def e15_li(spark, sf):
    return A.value_counts(load(spark, sf, "lineitem"), "l_linestatus")


@register("e16_dataset_profile", with_(*CAT_BASE) + f"""
select count(*) as row_count, count(distinct categoria) as category_count,
  count(*) > 10000 as large_dataset, count(distinct categoria) > 20 as many_categories,
  concat_ws(' | ', case when count(*) > 10000 then {q(ADVICE_LARGE)} end,
    case when count(distinct categoria) > 20 then {q(ADVICE_MANY_CATEGORIES)} end)
  as recommendations from cat""")
def e16(spark, sf):
    return A.dataset_profile(categorized(spark, sf))


@register("e16_lineitem_profile", f"""
select count(*) as row_count, count(distinct l_partkey) as category_count,
  count(*) > 10000 as large_dataset, count(distinct l_partkey) > 20 as many_categories,
  concat_ws(' | ', case when count(*) > 10000 then {q(ADVICE_LARGE)} end,
    case when count(distinct l_partkey) > 20 then {q(ADVICE_MANY_CATEGORIES)} end)
  as recommendations from lineitem""")
def e16_li(spark, sf):
    return A.dataset_profile(load(spark, sf, "lineitem"), cat="l_partkey")


@register("e1_lineitem_overall", """
select count(*) as total_gastos, round(sum(l_extendedprice), 2) as monto_total,
  round(avg(l_extendedprice), 2) as monto_promedio, round(median(l_extendedprice), 2) as monto_mediano
from lineitem""")
def e1_li(spark, sf):
    return A.overall(load(spark, sf, "lineitem"), amount="l_extendedprice")
