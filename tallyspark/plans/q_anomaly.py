"""Registered queries: statistical anomaly flags (F1, F3, F4 without F2, F5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import anomaly as N
from tallyspark.plans.oracle import CAT_BASE, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized_once, flagged_once, load

FLAGS = with_(*CAT_BASE) + """
, g as (select avg(monto) as m, stddev_samp(monto) as s from cat),
c as (select categoria, count(*) as n, avg(monto) as cm, stddev_samp(monto) as cs from cat group by categoria),
flags as (
  select cat.*,
    case when g.s is not null and g.s <> 0 then abs((monto - g.m) / g.s) end as z_score,
    coalesce(case when g.s is not null and g.s <> 0 then abs((monto - g.m) / g.s) > 2.0 end, false) as is_anomaly,
    coalesce(case when c.n > 3 and c.cs > 0 then abs((monto - c.cm) / c.cs) > 2.5 end, false) as is_category_anomaly
  from cat cross join g join c using (categoria))
"""


@register("f1_global_zscore", FLAGS + "select row_id, round(z_score, 6) as z_score, is_anomaly from flags")
def f1(spark, sf):
    return N.zscore_global(categorized_once(spark, sf)).select(
        "row_id", F.round("z_score", 6).alias("z_score"), "is_anomaly")


@register("f1_events_zscore", """
with g as (select avg(value) as m, stddev_samp(value) as s from events)
select event_id, round(abs((value - m) / s), 6) as z_score, abs((value - m) / s) > 2.0 as is_anomaly
from events, g""")
def f1_events(spark, sf):
    out = N.zscore_global(load(spark, sf, "events"), column="value")
    return out.select("event_id", F.round("z_score", 6).alias("z_score"), "is_anomaly")


@register("f3_category_zscore", FLAGS + "select row_id, categoria, is_category_anomaly from flags")
def f3(spark, sf):
    return N.zscore_by_category(categorized_once(spark, sf)).select("row_id", "categoria", "is_category_anomaly")


@register("f3_events_by_type", """
with c as (select event_type, count(*) as n, avg(value) as cm, stddev_samp(value) as cs from events group by 1)
select event_id, coalesce(case when n > 3 and cs > 0 then abs((value - cm) / cs) > 2.5 end, false)
  as is_category_anomaly from events join c using (event_type)""")
def f3_events(spark, sf):
    out = N.zscore_by_category(load(spark, sf, "events"), cat="event_type", column="value")
    return out.select("event_id", "is_category_anomaly")


@register("f4_any_anomaly", FLAGS + """
select row_id, is_anomaly, is_category_anomaly, is_anomaly or is_category_anomaly as is_any_anomaly from flags""")
def f4(spark, sf):
    return flagged_once(spark, sf).select("row_id", "is_anomaly", "is_category_anomaly", "is_any_anomaly")


@register("f5_anomaly_summary", FLAGS + """
select count(*) filter (where is_anomaly or is_category_anomaly) as total_detectadas,
  cast(0 as bigint) as ml_anomalies,
  count(*) filter (where is_category_anomaly) as category_anomalies,
  count(*) filter (where is_anomaly) as statistical_anomalies from flags""")
def f5(spark, sf):
    return N.anomaly_summary(flagged_once(spark, sf))


@register("f5_anomaly_listing", FLAGS + """
select row_id, descripcion, monto, categoria from flags where is_anomaly or is_category_anomaly""")
def f5_list(spark, sf):
    return flagged_once(spark, sf).where("is_any_anomaly").select("row_id", "descripcion", "monto", "categoria")
