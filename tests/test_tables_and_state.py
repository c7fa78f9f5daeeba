"""Rule tables, model bundles, pruned forests, mergeable aggregates, sketches and fingerprints."""

import math
import os
import random
import statistics

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallyspark.ml import bundle as B
from tallyspark.ml import categorizer as M
from tallyspark.ml.prune import with_min_samples_split
from tallyspark.ml.tabular import load_tabular, predict_one, predict_tabular, save_tabular, train_tabular
from tallyspark.operators import quality as Q
from tallyspark.operators import rule_table as R
from tallyspark.operators import state as S
from tallyspark.operators.order import global_rank
from tallyspark.operators.rules import categorize_first_match, categorize_weighted, pseudo_labels

SMALL = M.ModelConfig(num_trees=4, max_depth=4)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- rules as a table


def test_rule_table_equals_rule_columns(spark):
    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(F.monotonically_increasing_id().alias("k"), F.col("text").alias("descripcion"))
    extra = spark.createDataFrame([(-1, "  Bar y PUB!! la anonima, H&M remera "), (-2, None), (-3, ""), (-4, "zapatillas y medias"), (-5, "bar disco nafta")] , "k long, descripcion string")
    df = conv.unionByName(extra)
    rows = lambda x, *c: sorted(map(tuple, x.select("k", "categoria", *c).collect()))
    assert rows(R.categorize_by_rules(df, R.weighted_rules(spark)), "confidence", "method") == rows(categorize_weighted(df), "confidence", "method")
    assert rows(R.first_match_by_rules(df, R.first_match_rules(spark))) == rows(categorize_first_match(df))


@pytest.mark.parametrize("seed", [1, 2])
def test_rule_table_matches_brute_force(spark, seed):
    """Short, shared and overlapping keywords, ties between categories, an empty keyword."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abñ") for _ in range(n))
    rules = [(f"c{o}", o, rng.choice([10, 10, 20]), word(rng.choice([1, 2, 3, 3, 4, 6]))) for o in range(6) for _ in range(5)] + [("c9", 9, 50, "")]
    rules = sorted(set(rules))
    texts = [" ".join(word(rng.randint(1, 9)) for _ in range(rng.randint(0, 3))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, descripcion string")
    stop = ["a"]  # of these, only this is a stop word
    got = {r.k: (r.categoria, r.confidence) for r in R.categorize_by_rules(df, spark.createDataFrame(rules, R.SCHEMA)).collect()}
    for k, t in enumerate(texts):
        norm = " ".join(w for w in t.split() if w not in stop)
        score = {}
        for c, o, w, kw in rules:
            if kw and kw in norm:
                score[(o, c)] = score.get((o, c), 0) + w
        best = min(score, key=lambda x: (-score[x], x[0])) if score else None
        assert got[k] == (best[1] if best else "Otros", pytest.approx(min(score[best] / 50, 1.0) if best else 0.1))


def test_rule_table_plan_does_not_grow_with_keywords(spark):
    texts = spark.createDataFrame([("a", 1, 2)], "_key string, _h1 bigint, _h2 bigint")
    size = [plan_of(R.best_rule(texts, spark.range(n).select(F.lit("c").alias("category"), F.lit(0).alias("ord"), F.lit(10).alias("weight_tenths"), F.concat(F.lit("kw"), "id").alias("keyword")))).count("\n") for n in (10, 10_000)]
    assert size[0] == size[1]
    assert "BroadcastNestedLoopJoin" not in plan_of(R.best_rule(texts, R.weighted_rules(spark)))


def test_rule_table_keywords_are_never_broadcast(spark):
    """A small estimate proves nothing about the number of keywords; blanks, repeated rules and words count right."""
    rules = spark.createDataFrame([("a", 0, 10, "nafta super"), ("a", 0, 10, "super"), ("b", 1, 10, "naftalina"), ("b", 1, 10, "naftalina"), ("c", 2, 10, "r y"), ("c", 2, 10, "nafta")], R.SCHEMA)
    texts = spark.createDataFrame([("super nafta", 1), ("nafta super nafta", 2), ("naftalina naftalina", 3), ("otro", 4)], "t string, k int")
    hits = R.hits(texts, "t", rules, ["k"])
    assert "Broadcast" not in plan_of(hits)
    got = sorted((r.k, r.category, r.n) for r in hits.groupBy("k", "category").agg(F.sum("weight_tenths").alias("n")).collect())
    assert got == [(1, "a", 10), (1, "c", 10), (2, "a", 20), (2, "c", 10), (3, "b", 20), (3, "c", 10)]


# ---- bundles


@pytest.fixture(scope="module")
def labelled(spark):
    words = ["nafta ypf", "pizza y cerveza", "farmacia dosis", "cine entrada"]
    return spark.createDataFrame([(k, f"{words[k % 4]} {k % 7}", f"c{k % 4}") for k in range(200)], "row_id long, descripcion string, categoria string")


def files_of(path):
    return sorted((os.path.relpath(os.path.join(d, f), path), os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(path) for f in names)


def test_bundle_versions(spark, scratch, labelled, monkeypatch):
    path = os.path.join(scratch, "m")
    assert B.load_bundle(spark, path) is None and M.load_model(path) is None
    res = M.train(labelled, "categoria", SMALL)
    rules = spark.createDataFrame([("mine", 0, 15, "ypf")], R.SCHEMA)
    first = B.save_bundle(spark, res.model, path, rules)
    found = B.load_bundle(spark, path)
    assert found.version == first and [tuple(r) for r in found.rules.collect()] == [("mine", 0, 15, "ypf")]
    # a save that breaks off leaves the old bundle
    monkeypatch.setattr(B.Folder, "point_to", lambda self, version: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        B.save_bundle(spark, res.model, path)
    monkeypatch.undo()
    assert B.load_bundle(spark, path).version == first
    names = [B.save_bundle(spark, res.model, path) for _ in range(3)]
    assert B.load_bundle(spark, path).version == names[-1] and B.load_bundle(spark, path).rules.count() == 174
    assert sorted(os.listdir(os.path.join(path, "versions"))) == sorted(names[-2:])


def test_broken_bundle_is_an_error_and_stays(spark, scratch, labelled):
    path = os.path.join(scratch, "m")
    M.save_model(M.train(labelled, "categoria", SMALL), path)
    version = open(os.path.join(path, "CURRENT")).read().strip()
    meta = os.path.join(path, "versions", version, "pipeline", "metadata")
    for f in os.listdir(meta):
        os.remove(os.path.join(meta, f))
    before = files_of(path)
    with pytest.raises(Exception):
        M.load_model(path)
    with pytest.raises(Exception):
        M.categorize_smart(labelled, path, SMALL)
    assert files_of(path) == before


def test_tabular_model_restored(spark, scratch):
    rows = [(k, f"c{k % 3}", float(100 * (k % 3) + k % 5), None) for k in range(120)]
    df = spark.createDataFrame(rows, "row_id long, categoria string, monto double, fecha timestamp_ntz")
    model, accuracy = train_tabular(df, num_trees=5)
    assert accuracy > 0.5
    path = os.path.join(scratch, "t")
    assert load_tabular(path) is None
    save_tabular(model, path)
    again = load_tabular(path)
    assert predict_tabular(again, df).collect() == predict_tabular(model, df).collect()
    batch = {r.row_id: r.prediccion for r in predict_tabular(model, df).collect()}
    assert [predict_one(again, 100.0 * k) for k in range(3)] == [batch[0], batch[10], batch[5]]


# ---- splits and forests


def test_split_does_not_depend_on_partitioning(spark, labelled):
    sides = []
    for n in (1, 7):
        train, test = M.stratified_split(pseudo_labels(labelled.repartition(n)))
        sides.append((sorted(r.row_id for r in train.collect()), sorted(r.row_id for r in test.collect())))
    assert sides[0] == sides[1] and sides[0][1]
    accuracies = {M.train(labelled.repartition(n), "categoria", SMALL).accuracy for n in (1, 5)}
    assert len(accuracies) == 1


def walk(nodes, x, least):
    """Votes of a tree whose nodes under ``least`` rows end the walk."""
    at = 0
    while nodes[at]["leftChild"] >= 0 and nodes[at]["rawCount"] >= least:
        s = nodes[at]["split"]
        at = nodes[at]["leftChild"] if x[s["featureIndex"]] <= s["leftCategoriesOrThreshold"][0] else nodes[at]["rightChild"]
    stats = nodes[at]["impurityStats"]
    return [v / sum(stats) for v in stats]


def test_min_samples_split(spark, scratch):
    rng = random.Random(3)
    points = [[rng.random() for _ in range(3)] for _ in range(300)]
    df = spark.createDataFrame([(Vectors.dense(p), float(int(p[0] * 3 + rng.random()) % 3)) for p in points], ["features", "label"])
    forest = RandomForestClassifier(numTrees=6, maxDepth=9, seed=5).fit(df)
    forest.write().save(os.path.join(scratch, "f"))
    trees = {}
    for r in spark.read.parquet(os.path.join(scratch, "f", "data")).collect():
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData.asDict(recursive=True)
    pruned = with_min_samples_split(spark, forest, 12)
    pruned.write().save(os.path.join(scratch, "p"))
    nodes = [r.nodeData for r in spark.read.parquet(os.path.join(scratch, "p", "data")).collect()]
    assert len(nodes) < sum(map(len, trees.values())) and not any(n.leftChild >= 0 and n.rawCount < 12 for n in nodes)
    for r, p in zip(pruned.transform(df).select("probability").collect(), points, strict=True):
        votes = [walk(t, p, 12) for t in trees.values()]
        want = [sum(v[k] for v in votes) / len(votes) for k in range(3)]
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r.probability, want, strict=True))
    assert with_min_samples_split(spark, forest, 2).totalNumNodes == forest.totalNumNodes


def test_forest_scoring_runs_without_python(spark):
    from tallyspark.operators.iforest import fit_isolation_forest
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 11 > 0, F.col("id") % 5).cast("double").alias("b"))
    model = fit_isolation_forest(df, ["a", "b"], trees=5, max_samples=64)
    assert "Python" not in plan_of(model.transform(df)) and model.transform(df).where("iso_score is null").count() == 0


# ---- aggregates over appends


def made(spark, n=400, seed=1):
    rng = random.Random(seed)
    import datetime as dt
    rows = [(k, rng.choice(["a", "b", "b", None]), rng.choice([None, float("nan")]) if rng.random() < 0.05 else 1e6 + rng.random(),
             None if rng.random() < 0.1 else dt.datetime(2024, 1, 1 + rng.randrange(28), rng.randrange(24)), f"t{rng.randrange(30)}") for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, categoria string, monto double, fecha timestamp_ntz, descripcion string")


def test_states_merge_to_a_full_pass(spark):
    df = made(spark)
    parts = [df.where(F.col("row_id") % 4 == k) for k in range(4)]
    one, many = S.state_of(df), S.merge(*[S.state_of(p) for p in parts], S.state_of(df.limit(0)))
    assert many.count() == one.count()
    good = df.where("monto is not null and not isnan(monto)")
    amounts = [r.monto for r in good.collect()]
    r = S.overall(many).first()
    assert r.total_gastos == len(amounts) and r.std == pytest.approx(round(statistics.stdev(amounts), 2)) and (r.min, r.max) == (min(amounts), max(amounts))
    for f in (S.overall, S.by_category, S.monthly, S.daily, S.kpis):
        assert sorted(map(str, f(many).collect())) == sorted(map(str, f(one).collect()))
    exact = {x["categoria"]: x["s"] for x in good.groupBy("categoria").agg(F.stddev_samp("monto").alias("s")).collect()}
    for x in S.merged(many, ["categoria"]).collect():
        assert math.sqrt(x.m2 / (x.n - 1)) == pytest.approx(exact[x.categoria], rel=1e-6)
    assert S.kpis(many).first().descripciones == 30


def test_append_counts_each_batch_once(spark, scratch, monkeypatch):
    path, df = os.path.join(scratch, "s"), made(spark)
    assert S.current(spark, path) is None
    halves = [df.where("row_id < 150"), df.where("row_id >= 150")]
    assert S.append(spark, path, halves[0], "one") and not S.append(spark, path, halves[0], "one")
    before = S.overall(S.current(spark, path)).collect()
    with monkeypatch.context() as m:  # breaks off before the pointer moves
        m.setattr(S.Folder, "point_to", lambda self, version: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            S.append(spark, path, halves[1], "two")
    assert S.overall(S.current(spark, path)).collect() == before
    assert S.append(spark, path, halves[1], "two")
    assert S.by_category(S.current(spark, path)).orderBy("categoria").collect() == S.by_category(S.state_of(df)).orderBy("categoria").collect()


# ---- sketches, fingerprints, ranks


@pytest.mark.parametrize("distinct,choice", [(100, "category"), (4990, "category"), (5000, "string"), (5010, "string"), (9000, "string")])
def test_narrowing_is_exact_at_the_ratio(spark, distinct, choice):
    df = spark.range(10_000).select(F.concat(F.lit("v"), F.col("id") % distinct).alias("t"), F.lit(None).cast("string").alias("none"))
    assert {r.column: r.chosen_type for r in Q.narrowing_plan(df).collect()} == {"t": choice, "none": "category"}


def test_duplicate_rows_are_told_apart_by_their_nulls(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), (None, None, 1.0), ("ab", "", 1.0), ("a", "b", 1.0), (None, None, None)], "descripcion string, fecha string, monto double")
    assert Q.validate(df).first()["duplicate_rows"] == 1
    assert "Expand" not in plan_of(Q.validate(df))


def test_global_rank(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(9)
    assert all(r.x == r._rank for r in global_rank(df, ["x"]).collect())
