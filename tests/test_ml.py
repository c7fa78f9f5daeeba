"""D-operators, F2 and E14: invariants (learned models cannot equal another library row by row)."""

import os

import pytest
from pyspark.sql import functions as F

from tallyspark.ml import categorizer as M
from tallyspark.ml.evaluate import classification_report, label_codes
from tallyspark.sources.ingest import seed_training_set


@pytest.fixture(scope="module")
def seed_model(spark):
    return M.train(seed_training_set(spark), "categoria", M.BASE)


def test_train_on_seed_set(spark, seed_model):
    assert seed_model.status == "trained" and seed_model.samples == 80
    assert seed_model.accuracy >= 0.6
    assert seed_model.categories == sorted(seed_model.categories)
    row = seed_model.summary(spark).first()
    assert row["features"] == seed_model.features and row["samples"] == 80


def test_predict_confidence_and_save_load(spark, seed_model, scratch):
    df = spark.createDataFrame([("cine con amigos",), ("farmacia de guardia",), ("zzz",)], "descripcion string")
    out = M.predict_with_confidence(seed_model.model, df, "ml").collect()
    assert all(0.0 <= r["confidence"] <= 1.0 and r["method"] == "ml" for r in out)
    path = os.path.join(scratch, "model")
    M.save_model(seed_model, path)
    again = M.predict_with_confidence(M.load_model(path), df, "ml").collect()
    assert [r["categoria"] for r in again] == [r["categoria"] for r in out]
    assert M.load_model(os.path.join(scratch, "nope")) is None


def test_untrained_falls_back_to_rules(spark):
    tiny = spark.createDataFrame([("cine",), ("bar",)], "descripcion string")
    res = M.train(tiny.withColumn("categoria", F.lit("Otros")), "categoria")
    assert res.status == "rule_based" and res.model is None
    out = M.predict_with_confidence(None, tiny, "ml_improved").collect()
    assert {r["method"] for r in out} == {"rules_fallback"}


def test_stratified_split_exact(spark):
    seed = seed_training_set(spark)
    train, test = M.stratified_split(seed)
    assert test.count() == 16 and train.count() == 64
    assert test.groupBy("categoria").count().where("count = 2").count() == 8
    small = seed.limit(15)
    a, b = M.stratified_split(small)
    assert a.count() == b.count() == 15


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    rep = {r["label"]: r for r in classification_report(df, "t", "p").collect()}
    assert rep["c"]["precision"] == 0.0 and rep["c"]["recall"] == 0.0 and rep["c"]["support"] == 1
    assert rep["accuracy"]["precision"] == 0.5
    assert rep["b"]["precision"] == pytest.approx(1 / 3)
    codes = {r["categoria"]: r["code"] for r in label_codes(df.withColumnRenamed("t", "categoria")).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_isolation_forest_invariants(spark):
    from tallyspark.operators.iforest import isolation_forest_flags
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select(
        F.col("event_id").alias("row_id"), F.col("ts").alias("fecha"), F.col("value").alias("monto"))
    a = isolation_forest_flags(ev, trees=20)
    rows = a.select("row_id", "iso_score", "is_ml_anomaly").collect()
    n = len(rows)
    flagged = sum(r["is_ml_anomaly"] for r in rows)
    assert 0 < flagged <= 0.1 * n + 1
    assert all(0.0 < r["iso_score"] < 1.0 for r in rows)
    b = isolation_forest_flags(ev.repartition(5), trees=20).select("row_id", "iso_score").collect()
    assert sorted((r[0], r[1]) for r in b) == sorted((r[0], r[1]) for r in rows)
    top = max(rows, key=lambda r: r["iso_score"])
    assert top["is_ml_anomaly"]


def test_full_report(spark):
    import __spark_entry__ as E
    rep = E.queries()["e14_report_nested"](spark, "/root/testdata/sf0.001").first()
    assert rep["datos_procesados"]["total_gastos"] == 1365
    assert len(rep["top_gastos"]) == 5
    montos = [t["monto"] for t in rep["top_gastos"]]
    assert montos == sorted(montos, reverse=True)
    assert sum(v["cantidad"] for v in rep["categorias_detalladas"].values()) == 1365


def test_isolation_forest_scores_match_brute_force(spark):
    """The vectorised UDF walk equals a plain recursive walk of the same trees."""
    import math

    from tallyspark.operators.iforest import avg_path, fit_isolation_forest
    rows = [(i, float((i * 37) % 101), float(i % 24), float(i % 7)) for i in range(300)] + [(999, 5000.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    model = fit_isolation_forest(df, ["a", "b", "c"], trees=10, max_samples=64)
    got = {r["row_id"]: r["iso_score"] for r in model.transform(df).collect()}

    def path(tree, x, node=0, depth=0):
        feat, thr, left, right, size = tree
        if feat[node] < 0:
            return depth + float(avg_path(size[node]))
        nxt = left[node] if x[feat[node]] < thr[node] else right[node]
        return path(tree, x, nxt, depth + 1)
    c = float(avg_path(model.psi))
    for rid, a, b, cc in rows:
        mean_h = sum(path(t, (a, b, cc)) for t in model.trees) / len(model.trees)
        assert got[rid] == pytest.approx(math.pow(2.0, -mean_h / c), rel=1e-12)
    ranked = sorted(got.values(), reverse=True)
    assert got[999] >= ranked[len(ranked) // 20]   # the planted outlier is in the top 5%


def test_pipeline_keyword_sql_matches_column_features(spark):
    from pyspark.ml.feature import SQLTransformer

    from tallyspark.operators.rules import keyword_features
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        "conv_id", "turn", F.col("text").alias("descripcion"))
    extra = spark.createDataFrame([(-1, 0, "  Bar y PUB!! la anonima, H&M remera "), (-2, 0, None)],
                                  "conv_id long, turn long, descripcion string")
    conv = conv.unionByName(extra)
    a = SQLTransformer(statement=M.keyword_sql("descripcion")).transform(conv)
    b = keyword_features(conv)
    cols = [f"kw_{i}" for i in range(8)]
    ra = sorted(tuple(r) for r in a.select("conv_id", "turn", *cols).collect())
    rb = sorted(tuple(r) for r in b.select("conv_id", "turn", *cols).collect())
    assert ra == rb


def test_tfidf_tasks_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """Terms are counted in tasks of a bounded amount of text, which aren't merged; weights are those of one task."""
    from tallyspark.ml import tfidf as T
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17:02d}" for j in range(40))) for k in range(60)], "doc long, text string")
    want = {(r.doc, r.term): r.weight for r in T.tfidf(docs, "doc", "text").collect()}
    seen = []
    monkeypatch.setattr(T, "TASK_BYTES", 1000)
    monkeypatch.setattr(T, "materialize", lambda df, keep=T.materialize: seen.append(df.rdd.getNumPartitions()) or keep(df))
    got = {(r.doc, r.term): r.weight for r in T.tfidf(docs, "doc", "text").collect()}
    assert seen == [60 * 159 // 1000 + 1]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
