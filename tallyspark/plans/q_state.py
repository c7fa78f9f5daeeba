"""Registered queries: rule tables, restored bundles, aggregates over appends, checks of learned operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.constants import DEFAULT_CATEGORY
from tallyspark.ml import categorizer as M
from tallyspark.ml.bundle import load_bundle
from tallyspark.ml.tabular import load_tabular, predict_tabular, save_tabular, train_tabular
from tallyspark.operators import rule_table as R
from tallyspark.operators import state as S
from tallyspark.plans.oracle import BASE, CAT_BASE, FRULES, first_match_cte, norm_sql, q, with_
from tallyspark.plans.q_anomaly import FLAGS
from tallyspark.plans.q_files import _kept, scratch
from tallyspark.plans.registry import register
from tallyspark.plans.views import categorized, categorized_once, expenses, load
from tallyspark.session import materialize
from tallyspark.sources.files import file_inventory
from tallyspark.sources.ingest import SEED_PHRASES, seed_training_set

# ---- C1-C3 over a table of rules


@register("c1_rule_table", with_(*BASE, FRULES, first_match_cte("expenses")) + "select e.row_id, f.categoria from expenses e join fm f on e.descripcion = f.t")
def c1_table(spark, sf):
    return R.first_match_by_rules(expenses(spark, sf), R.first_match_rules(spark)).select("row_id", "categoria")


WORDS = r"""rules as (select kw, length(kw) % 9 as ord, 10 + length(kw) % 7 as w10 from (
  select distinct unnest(regexp_extract_all(lower(text), '[\p{L}]{6,}')) as kw from documents))"""


@register("c2_rule_table_documents_words", f"""
with {WORDS},
t as (select conv_id, turn, {norm_sql('text')} as nt from conversations),
s as (select conv_id, turn, ord, sum(w10) as s from t join rules on contains(nt, kw) group by conv_id, turn, ord),
b as (select * from s qualify row_number() over (partition by conv_id, turn order by s desc, ord) = 1)
select t.conv_id, t.turn, coalesce('c' || ord, {q(DEFAULT_CATEGORY)}) as categoria, round(case when s > 0 then least(s / 50.0, 1.0) else 0.1 end, 6) as confidence
from t left join b using (conv_id, turn)""")
def c2_words(spark, sf):
    """Tens of thousands of keywords: every word of six letters or more of the documents, in nine categories."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{6,})"), F.lit(1))
    kw = load(spark, sf, "documents").select(F.explode(words).alias("keyword")).distinct()
    ord_ = (F.length("keyword") % 9).cast("int")
    rules = materialize(kw.select(F.concat(F.lit("c"), ord_).alias("category"), ord_.alias("ord"), (F.length("keyword") % 7 + 10).cast("int").alias("weight_tenths"), "keyword"))
    out = R.categorize_by_rules(load(spark, sf, "conversations"), rules, "text")
    return out.select("conv_id", "turn", "categoria", F.round("confidence", 6).alias("confidence"))


SMALL = M.ModelConfig(num_trees=8, max_depth=5)


@register("d14_restored_rules", with_(*CAT_BASE) + "select row_id, categoria, round(confidence, 6) as confidence, method from cat")
def d14_rules(spark, sf):
    """The rule table that comes back with a saved model categorises as the rules do."""
    df = materialize(expenses(spark, sf))
    path = scratch(spark, "d14r")
    M.save_model(M.train(df, cfg=SMALL), path)
    out = R.categorize_by_rules(df, load_bundle(spark, path).rules)
    return _kept(spark, out.select("row_id", "categoria", F.round("confidence", 6).alias("confidence"), "method"), path)


# ---- learned operators


@register("d7_split_checks", with_(*BASE) + "select count(*) as filas, 0::bigint as divididos_pequenos, 0::bigint as sin_categoria from expenses")
def d7_checks(spark, sf):
    """No node with fewer training rows than min_samples_split is split, and every row gets a category."""
    df = materialize(expenses(spark, sf))
    res = M.train(df, cfg=M.IMPROVED)
    path = scratch(spark, "d7")
    res.model.stages[-2].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*")
    small = nodes.agg(F.count_if((F.col("leftChild") >= 0) & (F.col("rawCount") < M.IMPROVED.min_samples_split)).alias("divididos_pequenos"))
    out = M.predict_with_confidence(res.model, df)
    return _kept(spark, out.agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("categoria").isNull()).alias("sin_categoria")).crossJoin(small), path)


SEEDS = "seeds(descripcion, categoria) as (values " + ", ".join(f"({q(d)}, {q(c)})" for d, c in SEED_PHRASES) + ")"


@register("d13_seed_checks", with_(*CAT_BASE, SEEDS) + """
, a as (select categoria from cat union all select categoria from seeds)
select 'trained' as status, count(*) as samples, string_agg(distinct categoria, ',' order by categoria) as categorias, true as aprende from a""")
def d13_checks(spark, sf):
    """Samples and categories of the seed set with the user's rows; the hold-out accuracy is above 0.8."""
    user = categorized_once(spark, sf).select("row_id", "descripcion", "categoria")
    r = M.improve_with_user_data(seed_training_set(spark), user, M.BASE)
    return r.summary(spark).select("status", "samples", F.array_join("categories", ",").alias("categorias"), (F.col("accuracy") > 0.8).alias("aprende"))


@register("a12_seed_and_user_rows", with_(*CAT_BASE, SEEDS) + """
select categoria, descripcion, count(*) as n from (select descripcion, categoria from seeds union all select descripcion, categoria from cat) a
group by categoria, descripcion""")
def a12(spark, sf):
    """The seed phrases as values, beside the categorised descriptions."""
    every = seed_training_set(spark).unionByName(categorized(spark, sf).select("descripcion", "categoria"))
    return every.groupBy("categoria", "descripcion").agg(F.count(F.lit(1)).alias("n"))


@register("d15_tabular_restored", with_(*BASE) + "select count(*) as filas, 0::bigint as distintas, 0::bigint as sin_prediccion from expenses")
def d15_restored(spark, sf):
    """Predictions of the tabular model in memory and of the one read back."""
    df = categorized_once(spark, sf)
    model, _ = train_tabular(df, num_trees=20)
    path = scratch(spark, "d15")
    save_tabular(model, path)
    one = predict_tabular(model, df).select("row_id", F.col("prediccion").alias("p1"))
    two = predict_tabular(load_tabular(path), df).select("row_id", F.col("prediccion").alias("p2"))
    return _kept(spark, one.join(two, "row_id", "full").agg(F.count(F.lit(1)).alias("filas"), F.count_if(~F.col("p1").eqNullSafe(F.col("p2"))).alias("distintas"),
                                                            F.count_if(F.col("p2").isNull()).alias("sin_prediccion")), path)


# ---- A5 over files that Spark writes from a table


@register("a5_inventory_of_written_files", """
select sum(strlen(p_name) + 1)::bigint as size, round(sum(strlen(p_name) + 1) / 1048576.0, 2) as size_mb, '.txt' as extension, true as is_supported
from part group by p_brand""")
def a5_written(spark, sf):
    """One text file of names per brand."""
    path = scratch(spark, "a5")
    names = load(spark, sf, "part").select("p_brand", F.col("p_name").alias("value"))
    names.repartition("p_brand").write.partitionBy("p_brand").text(path)
    return _kept(spark, file_inventory(spark, path).where("extension = '.txt'").select("size", "size_mb", "extension", "is_supported"), path)


# ---- aggregates over appends

PARTS = 3


def _state(spark, sf, path):
    """Categorised expenses, appended in batches; the last batch is sent twice."""
    rows = categorized_once(spark, sf)
    for k in [*range(PARTS), PARTS - 1]:
        S.append(spark, path, rows.where(F.col("row_id") % PARTS == k), f"batch-{k}")
    return rows, S.current(spark, path)


def _over_appends(name, sql, finish):
    @register(name, sql)
    def query(spark, sf):
        path = scratch(spark, "state")
        return _kept(spark, finish(*_state(spark, sf, path)), path)


_over_appends("e1_over_appends", with_(*CAT_BASE) + """
select count(*) as total_gastos, round(sum(monto), 2) as monto_total, round(avg(monto), 2) as monto_promedio, max(monto) as max, min(monto) as min,
  round(stddev_samp(monto), 2) as std from cat""", lambda rows, state: S.overall(state))
_over_appends("e2_over_appends", with_(*CAT_BASE) + """
select categoria, round(sum(monto), 2) as "sum", count(*) as "count", round(avg(monto), 2) as "mean" from cat group by categoria""", lambda rows, state: S.by_category(state))
_over_appends("e4_over_appends", with_(*CAT_BASE) + """
select year(fecha) as "año", month(fecha) as mes, round(sum(monto), 2) as monto from cat where fecha is not null group by 1, 2""",
              lambda rows, state: S.monthly(state).select(F.col("año").cast("bigint"), F.col("mes").cast("bigint"), "monto"))
_over_appends("e6_over_appends", with_(*CAT_BASE) + """
select fecha::date as fecha, round(sum(monto), 2) as monto from cat where fecha is not null group by 1""", lambda rows, state: S.daily(state))
_over_appends("e13_over_appends", with_(*CAT_BASE) + """
select count(*) as transacciones, round(sum(monto), 2) as total, round(avg(monto), 2) as promedio, count(distinct categoria) as categorias from cat""",
              lambda rows, state: S.kpis(state).drop("descripciones"))
_over_appends("f1_f3_over_appends", FLAGS + "select row_id, round(z_score, 6) as z_score, is_anomaly, is_category_anomaly from flags",
              lambda rows, state: S.flags(rows, state).select("row_id", F.round("z_score", 6).alias("z_score"), "is_anomaly", "is_category_anomaly"))
