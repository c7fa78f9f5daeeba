"""Registered queries: rule categorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import rules as R
from tallyspark.operators.reuse import cache_stats, categorize_distinct
from tallyspark.plans.oracle import (BASE, CAT_BASE, FRULES, WRULES, first_match_cte, norm_sql,
                                     weighted_cte, with_)
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized, expenses, load


@register("c1_first_match", with_(*BASE, FRULES, first_match_cte("expenses")) + """
select e.row_id, f.categoria from expenses e join fm f on e.descripcion = f.t""")
def c1(spark, sf):
    return R.categorize_first_match(expenses(spark, sf)).select("row_id", "categoria")


@register("c2_weighted", with_(*CAT_BASE) + "select row_id, categoria from cat")
def c2(spark, sf):
    return R.categorize_weighted(expenses(spark, sf), with_confidence=False).select("row_id", "categoria")


@register("c3_rule_confidence", with_(*CAT_BASE) + """
select row_id, categoria, round(confidence, 6) as confidence, method from cat""")
def c3(spark, sf):
    return categorized(spark, sf).select("row_id", "categoria", F.round("confidence", 6).alias("confidence"),
                                         "method")


@register("c4_pseudo_labels", with_(*CAT_BASE) + """
select e.descripcion, s.categoria, round(s.s10 / 10.0, 6) as confidence
from expenses e join scored s on e.descripcion = s.t where s.s10 > 10""")
def c4(spark, sf):
    out = R.pseudo_labels(expenses(spark, sf))
    return out.select("descripcion", "categoria", F.round("confidence", 6).alias("confidence"))


def _kw_sql() -> str:
    from tallyspark.constants import WEIGHTED_RULES
    cols = ", ".join(
        f"round(coalesce(sum(r.w10) filter (where r.ord = {i}), 0) / 10.0, 6) as kw_{i}"
        for i in range(len(WEIGHTED_RULES)))
    return with_(*BASE, WRULES) + f"""
, t as (select row_id, {norm_sql('descripcion')} as nt from expenses)
select t.row_id, {cols} from t left join wrules r on contains(t.nt, r.kw) group by t.row_id"""


@register("c5_keyword_features", _kw_sql())
def c5(spark, sf):
    out = R.keyword_features(expenses(spark, sf).select("row_id", "descripcion"))
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("kw_")])


@register("c6_category_distribution", with_(*CAT_BASE) + """
select categoria, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percentage
from cat group by categoria""")
def c6(spark, sf):
    out = R.category_distribution(categorized(spark, sf))
    return out.select("categoria", "count", F.round("percentage", 6).alias("percentage"))


@register("c6_distribution_documents_source", """
select source as categoria, count(*) as count, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percentage
from documents group by source""")
def c6_docs(spark, sf):
    out = R.category_distribution(load(spark, sf, "documents"), col="source")
    return out.select("categoria", "count", F.round("percentage", 6).alias("percentage"))


@register("c7_prediction_cache_stats", with_(*BASE) + """
select count(*) as total_predictions, count(distinct lower(trim(descripcion))) as cache_size,
  count(*) - count(distinct lower(trim(descripcion))) as cache_hits,
  count(distinct lower(trim(descripcion))) as cache_misses,
  round(1 - count(distinct lower(trim(descripcion))) / count(*), 6) as hit_rate
from expenses""")
def c7(spark, sf):
    return cache_stats(expenses(spark, sf))


@register("c7_categorize_distinct", with_(*CAT_BASE) + """
select row_id, categoria, round(confidence, 6) as confidence, method from cat""")
def c7b(spark, sf):
    out = categorize_distinct(expenses(spark, sf))
    return out.select("row_id", "categoria", F.round("confidence", 6).alias("confidence"), "method")


@register("c2_weighted_conversations", with_(WRULES, weighted_cte("conversations", "text", "sc")) + """
select c.conv_id, c.turn, s.categoria, round(case when s.s10 > 0 then least(s.s10 / 50.0, 1.0) else 0.1 end, 6)
  as confidence from conversations c join sc s on c.text = s.t""")
def c2_conv(spark, sf):
    out = R.categorize_weighted(load(spark, sf, "conversations"), text_col="text")
    return out.select("conv_id", "turn", "categoria", F.round("confidence", 6).alias("confidence"))


@register("c2_weighted_documents", with_(WRULES, weighted_cte("documents", "text", "sd")) + """
select d.doc_id, s.categoria, s.s10 as score_tenths from documents d join sd s on d.text = s.t""")
def c2_docs(spark, sf):
    out = R.rule_score(load(spark, sf, "documents"), text_col="text")
    return out.select("doc_id", "categoria", (F.round(F.col("score") * 10)).cast("int").alias("score_tenths"))


@register("c1_first_match_documents", with_(FRULES, first_match_cte("documents", "text", "fd")) + """
select d.doc_id, f.categoria from documents d join fd f on d.text = f.t""")
def c1_docs(spark, sf):
    return R.categorize_first_match(load(spark, sf, "documents"), text_col="text").select("doc_id", "categoria")
