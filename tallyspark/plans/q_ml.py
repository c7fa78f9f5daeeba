"""Registered queries: learned categorisation (D1-D16) and the isolation forest (F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import normalize_for_matching
from tallyspark.ml import categorizer as M
from tallyspark.ml.evaluate import classification_report, evaluation_triples, label_codes
from tallyspark.ml.tabular import predict_tabular, train_tabular
from tallyspark.ml.tfidf import tfidf
from tallyspark.operators.iforest import isolation_forest_flags
from tallyspark.constants import PSEUDO_LABEL_MIN_SCORE
from tallyspark.operators.rules import categorize_first_match, rule_score
from tallyspark.plans.oracle import BASE, CAT_BASE, FRULES, first_match_cte, norm_sql, with_
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized, categorized_once, expenses, load
from tallyspark.session import materialize
from tallyspark.sources.ingest import seed_training_set

TOK = r"'[\p{L}\p{N}_]{2,}'"


def _tfidf_sql(src: str, max_features: int, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False) -> str:
    maxdf = f"and df <= floor({max_df} * n)" if max_df < 1.0 else ""
    tfw = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
, toks as (select doc, regexp_extract_all(txt, {TOK}) as t from {src}),
terms as (
  select doc, unnest(list_concat(t, case when len(t) > 1 then
    list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) else [] end)) as term from toks),
tf as (select doc, term, count(*) as tf from terms group by doc, term),
n as (select count(*) as n from {src}),
st as (select term, count(*) as df, sum(tf) as cf from tf group by term),
vocab as (select term, ln((1 + n) / (1 + df)) + 1 as idf from st, n where df >= {min_df} {maxdf}
          order by cf desc, term limit {max_features}),
w as (select doc, term, {tfw} * idf as w from tf join vocab using (term))
select doc, term, round(w / sqrt(sum(w * w) over (partition by doc)), 6) as weight from w"""


@register("d1_tfidf_descriptions", with_(*BASE) + f"""
, d as (select distinct {norm_sql('descripcion')} as doc, {norm_sql('descripcion')} as txt from expenses)"""
          + _tfidf_sql("d", 1000))
def d1(spark, sf):
    docs = expenses(spark, sf).select(normalize_for_matching(F.col("descripcion")).alias("doc")).distinct()
    out = tfidf(docs.withColumn("txt", F.col("doc")), "doc", "txt", max_features=1000)
    return out.select("doc", "term", F.round("weight", 6).alias("weight"))


@register("d2_tfidf_documents", f"""
with d as (select doc_id as doc, {norm_sql('text')} as txt from documents)"""
          + _tfidf_sql("d", 500, min_df=2, max_df=0.95, sublinear=True))
def d2(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("doc"),
                                               normalize_for_matching(F.col("text")).alias("txt"))
    out = tfidf(docs, "doc", "txt", max_features=500, min_df=2, max_df=0.95, sublinear_tf=True)
    return out.select("doc", "term", F.round("weight", 6).alias("weight"))


@register("d4_label_codes", with_(*CAT_BASE) + """
select categoria, cast(dense_rank() over (order by categoria) - 1 as integer) as code
from (select distinct categoria from cat) x""")
def d4(spark, sf):
    return label_codes(categorized(spark, sf))


def _report_sql(src: str) -> str:
    return f"""
, pairs as (select t, p, count(*) as n from {src} group by t, p),
labels as (select t as label from pairs union select p from pairs),
per as (
  select l.label, coalesce((select sum(n) from pairs where t = l.label), 0) as support,
    coalesce((select sum(n) from pairs where p = l.label), 0) as pred,
    coalesce((select sum(n) from pairs where t = l.label and p = l.label), 0) as tp from labels l),
m as (select label, support, tp,
        case when pred > 0 then tp / pred else 0.0 end as precision,
        case when support > 0 then tp / support else 0.0 end as recall from per),
m2 as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end
        as f1_score from m),
tot as (select sum(support) as n, sum(tp) as tp, avg(precision) as mp, avg(recall) as mr, avg(f1_score) as mf,
          sum(precision * support) as wp, sum(recall * support) as wr, sum(f1_score * support) as wf from m2),
allr as (
  select label, precision, recall, f1_score, support from m2
  union all select 'accuracy', tp / n, tp / n, tp / n, n from tot
  union all select 'macro avg', mp, mr, mf, n from tot
  union all select 'weighted avg', wp / n, wr / n, wf / n, n from tot)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score,
  cast(support as bigint) as support from allr"""


@register("d12_evaluate_rules", with_(*CAT_BASE, FRULES, first_match_cte("expenses", name="fmx")) + """
, ev as (select f.categoria as t, c.categoria as p from cat c join fmx f on c.descripcion = f.t)"""
          + _report_sql("ev"))
def d12(spark, sf):
    df = categorize_first_match(categorized(spark, sf).withColumnRenamed("categoria", "predicha"), "real")
    return classification_report(df, "real", "predicha")


@register("d12_evaluate_labels", """
with ev as (select cast(l.quality as varchar) as t, case when d.n_chars >= 1000 then '1' else '0' end as p
            from labels l join documents d using (doc_id))""" + _report_sql("ev"))
def d12_labels(spark, sf):
    lab = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id").select(
        F.col("quality").cast("string").alias("real"),
        F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("predicha"))
    return classification_report(j, "real", "predicha")


@register("d3_feature_matrix")
def d3(spark, sf):
    """D3: the assembled feature vector (tf-idf ++ 8 keyword scores) of every row."""
    from pyspark.ml.functions import vector_to_array
    df = expenses(spark, sf)
    res = M.train(df, cfg=M.BASE)
    feats = M.feature_model(res.model).transform(df)
    arr = vector_to_array("features")
    return feats.select("row_id", F.size(arr).alias("n_features"),
                        F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"))


@register("d5_stratified_split", with_(*CAT_BASE) + """
, pl as (select e.descripcion, s.categoria from expenses e join scored s on e.descripcion = s.t where s.s10 > 10),
c as (select categoria, count(*) as n from pl group by categoria)
select categoria, 'test' as parte, cast(round(0.2 * n) as bigint) as n, 0::bigint as en_ambas from c
union all select categoria, 'train', n - cast(round(0.2 * n) as bigint), 0::bigint from c""")
def d5(spark, sf):
    """Sizes per category and side (every category has test rows), and rows that are on both sides."""
    scored = rule_score(expenses(spark, sf))
    data = scored.where(F.col("score") > PSEUDO_LABEL_MIN_SCORE).select("row_id", "descripcion", "categoria")
    train, test = M.stratified_split(data)
    sides = train.withColumn("parte", F.lit("train")).unionByName(test.withColumn("parte", F.lit("test")))
    twice = sides.groupBy("row_id").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    return (sides.join(twice, "row_id", "left").groupBy("categoria", "parte")
                 .agg(F.count(F.lit(1)).alias("n"), F.count("_m").alias("en_ambas")))


@register("d9_training_summary")
def d9(spark, sf):
    res = M.train(expenses(spark, sf), cfg=M.IMPROVED)
    return res.summary(spark)


@register("d11_predict_with_confidence")
def d11(spark, sf):
    df = expenses(spark, sf)
    res = M.train(df, cfg=M.IMPROVED)
    out = M.predict_with_confidence(res.model, df, M.IMPROVED.method)
    return out.select("row_id", "descripcion", "categoria", F.round("confidence", 6).alias("confidence"), "method")


@register("d13_seed_plus_user_labels")
def d13(spark, sf):
    user = categorized(spark, sf).select("descripcion", "categoria")
    res = M.improve_with_user_data(seed_training_set(spark), user, M.BASE)
    return res.summary(spark)


@register("d15_tabular_classifier")
def d15(spark, sf):
    df = categorized_once(spark, sf)
    model, acc = train_tabular(df)
    return predict_tabular(model, df).select("row_id", "categoria", "prediccion")


@register("d16_categorize_smart")
def d16(spark, sf):
    out, _ = M.categorize_smart(expenses(spark, sf))
    return out.select("row_id", "categoria", F.round("confidence", 6).alias("confidence"), "method")


@register("f2_isolation_forest_events")
def f2_events(spark, sf):
    ev = load(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("ts").alias("fecha"),
                                          F.col("value").alias("monto"))
    out = isolation_forest_flags(ev)
    return out.select("row_id", F.round("iso_score", 6).alias("iso_score"), "is_ml_anomaly")


@register("f2_isolation_forest_expenses")
def f2(spark, sf):
    out = isolation_forest_flags(expenses(spark, sf))
    return out.select("row_id", F.round("iso_score", 6).alias("iso_score"), "is_ml_anomaly")


# ---- what can be compared of the learned operators

VOCAB = f"""
, pl as (select e.descripcion, s.categoria from expenses e join scored s on e.descripcion = s.t where s.s10 > 10),
toks as (select row_number() over () as doc, regexp_extract_all({norm_sql('descripcion')}, {TOK}) as t from pl),
terms as (
  select doc, unnest(list_concat(t, case when len(t) > 1 then
    list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) else [] end)) as term from toks),
st as (select term, count(distinct doc) as df from terms group by term),
vocab as (select term from st where df >= 2 and df <= floor(0.95 * (select count(*) from pl)) limit 500)"""


@register("d9_training_checks", with_(*CAT_BASE) + VOCAB + """
select 'trained_improved' as status, count(*) as samples, string_agg(distinct categoria, ',' order by categoria) as categorias,
  cast((select count(*) from vocab) + 8 as integer) as features, true as aprende from pl""")
def d9_checks(spark, sf):
    """Samples, categories and feature count; the hold-out accuracy is above 0.9."""
    r = M.train(materialize(expenses(spark, sf)), cfg=M.IMPROVED)
    return r.summary(spark).select("status", "samples", F.array_join("categories", ",").alias("categorias"), "features", (F.col("accuracy") > 0.9).alias("aprende"))


@register("d3_feature_sizes", with_(*CAT_BASE) + VOCAB.replace("df >= 2 and df <= floor(0.95 * (select count(*) from pl)) limit 500", "true limit 1000") + """
select count(*) as filas, cast((select count(*) from vocab) + 8 as integer) as menor, cast((select count(*) from vocab) + 8 as integer) as mayor from expenses""")
def d3_sizes(spark, sf):
    return d3(spark, sf).agg(F.count(F.lit(1)).alias("filas"), F.min("n_features").alias("menor"), F.max("n_features").alias("mayor"))


CHECKS = with_(*BASE) + """
select count(*) as filas, 0::bigint as sin_categoria, 0::bigint as fuera_de_rango, true as de_acuerdo, 'ml_improved' as method from expenses"""


def _checks(spark, sf, out):
    """Rows, missing categories, confidences out of (0, 1], agreement with the rules on at least 0.8."""
    rules = categorized(spark, sf).select("row_id", F.col("categoria").alias("regla"))
    c = F.col("confidence")
    same = F.avg((F.col("categoria") == F.col("regla")).cast("int"))
    return out.join(rules, "row_id").agg(
        F.count(F.lit(1)).alias("filas"), F.count_if(F.col("categoria").isNull()).alias("sin_categoria"),
        F.count_if(~((c > 0) & (c <= 1.0000001))).alias("fuera_de_rango"), (same >= 0.8).alias("de_acuerdo"), F.max("method").alias("method"))


@register("d11_prediction_checks", CHECKS)
def d11_checks(spark, sf):
    return _checks(spark, sf, d11(spark, sf))


@register("d16_smart_checks", CHECKS)
def d16_checks(spark, sf):
    return _checks(spark, sf, d16(spark, sf))


@register("d16_cache_stats", with_(*BASE) + """
select count(*) as total_predictions, count(distinct lower(trim(descripcion))) as cache_size,
  count(*) - count(distinct lower(trim(descripcion))) as cache_hits,
  count(distinct lower(trim(descripcion))) as cache_misses,
  round(1 - count(distinct lower(trim(descripcion))) / count(*), 6) as hit_rate from expenses""")
def d16_stats(spark, sf):
    return M.smart_cache_stats(expenses(spark, sf))


@register("d12_evaluation_listing", with_(*CAT_BASE, FRULES, first_match_cte("expenses", name="fmx")) + """
select c.descripcion, f.categoria as "real", c.categoria as predicha from cat c join fmx f on c.descripcion = f.t""")
def d12_listing(spark, sf):
    df = categorize_first_match(categorized(spark, sf).withColumnRenamed("categoria", "predicha"), "real")
    return evaluation_triples(df, "descripcion", "real", "predicha")


@register("d2_pipeline_weights", with_(*BASE) + f"""
, d as (select row_id as doc, {norm_sql('descripcion')} as txt from expenses)"""
          + _tfidf_sql("d", 500, min_df=2, max_df=0.95, sublinear=True))
def d2_pipeline(spark, sf):
    """The fitted feature pipeline's weights equal the relational ones."""
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array
    df = materialize(expenses(spark, sf).select("row_id", "descripcion"))
    feats = M.fit_features(M.IMPROVED, df)
    words = next(s.vocabulary for s in feats.stages if isinstance(s, CountVectorizerModel))  # 500 at most
    at = feats.transform(df).select(F.col("row_id").alias("doc"), F.posexplode(vector_to_array("_tfidf_n")).alias("i", "w")).where("w > 0")
    return at.select("doc", F.element_at(F.array(*map(F.lit, words)), F.col("i") + 1).alias("term"), F.round("w", 6).alias("weight"))


@register("d15_tabular_checks", with_(*BASE) + "select count(*) as filas, 0::bigint as sin_prediccion from expenses")
def d15_checks(spark, sf):
    return d15(spark, sf).agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("prediccion").isNull()).alias("sin_prediccion"))


@register("f2_events_checks", "select count(*) as filas, 0::bigint as fuera_de_rango, true as parte_marcada from events")
def f2_checks(spark, sf):
    """Every row scored; at most a tenth flagged, and not far fewer."""
    s = F.col("iso_score")
    share = F.avg(F.col("is_ml_anomaly").cast("int"))
    return f2_events(spark, sf).agg(F.count(F.lit(1)).alias("filas"), F.count_if(~((s > 0) & (s < 1))).alias("fuera_de_rango"),
                                    ((share <= 0.1) & (share > 0.08)).alias("parte_marcada"))
