"""Learned categorisation (D1-D11, D13, D14, D16) with stock Spark ML stages.

Model = one ``PipelineModel``:

  SQLTransformer (B6 text normalisation + C5 keyword scores, generated
  from the rule table) -> RegexTokenizer -> NGram(2) -> SQLTransformer
  (unigrams ++ bigrams) -> CountVectorizerModel -> SublinearTF (D2 only)
  -> ElementwiseProduct (smooth idf) -> Normalizer(L2) ->
  VectorAssembler(tf-idf, 8 keyword scores) -> RandomForest ->
  IndexToString.

Every stage is a stock stage or a transformer with default-params
persistence, so ``PipelineModel.save/load`` is the model bundle (D14).  Training data is whatever Spark derives from
the tables (pseudo-labels, C4) plus the seed set; ``fit`` is Spark's
distributed tree learner.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer,
                                RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.constants import (MIN_TRAINING_ROWS, SEED, SPLIT_MIN_ROWS, STOP_WORDS, TEST_FRACTION,
                                  WEIGHTED_RULES, weight_tenths)
from tallyspark.functions.text import cache_key
from tallyspark.ml.bundle import load_bundle, save_bundle
from tallyspark.ml.prune import with_min_samples_split
from tallyspark.ml.tfidf import TOKEN_RX, vocabulary
from tallyspark.operators.reuse import cache_stats, score_distinct
from tallyspark.operators.rules import categorize_weighted, pseudo_labels
from tallyspark.session import materialize

SPLIT_BUCKETS = 1 << 16
FOREST_MB = 1024  # statistics of the nodes that grow in one pass over the rows
# Sublinear term frequency (D2); the vocabulary comes from the relational statistics (tfidf.vocabulary).


@dataclass
class ModelConfig:
    """D1/D6 (base) and D2/D7 (improved) settings."""
    vocab_size: int = 1000
    min_df: float = 1.0             # >= 1: a document count
    max_df: float | None = None     # in [0, 1): a fraction; None: no upper bound
    num_trees: int = 100
    max_depth: int = 10
    min_instances_per_node: int = 1
    min_samples_split: int = 2      # nodes with fewer training rows are not split
    feature_subset: str = "auto"
    balanced: bool = False
    sublinear_tf: bool = False
    method: str = "ml"


BASE = ModelConfig()
IMPROVED = ModelConfig(vocab_size=500, min_df=2.0, max_df=0.95, num_trees=150, max_depth=15,
                       min_instances_per_node=2, min_samples_split=5, feature_subset="sqrt", balanced=True, sublinear_tf=True, method="ml_improved")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_sql(text_col: str) -> str:
    """B6 + C5 as one SQL projection (used inside the saved pipeline)."""
    stop = ", ".join(_sql_str(w) for w in STOP_WORDS)
    norm = (f"coalesce(array_join(filter(split(trim(regexp_replace(lower({text_col}), "
            f"'[^\\\\p{{L}}\\\\p{{N}}_]+', ' ')), ' '), "
            f"w -> length(w) > 0 AND NOT array_contains(array({stop}), w)), ' '), '')")
    # one int column per keyword, then one sum per category: small generated
    # methods instead of one huge expression
    hits, sums, all_names = [], [], []
    for i, (_, weight, keywords) in enumerate(WEIGHTED_RULES):
        names = [f"_k{i}_{j}" for j in range(len(keywords))]
        all_names += names
        hits += [f"CAST(contains(_norm, {_sql_str(k)}) AS INT) AS {n}" for k, n in zip(keywords, names)]
        sums.append(f"({' + '.join(names)}) * {weight_tenths(weight)} / 10.0D AS kw_{i}")
    return (f"SELECT * EXCEPT ({', '.join(all_names)}), {', '.join(sums)} FROM "
            f"(SELECT *, {', '.join(hits)} FROM (SELECT *, {norm} AS _norm FROM __THIS__))")


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts to 1 + ln(count), 0 stays 0; built-in array functions, saved with its parameters."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        damped = F.transform(vector_to_array(self.getInputCol()), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))
        return df.withColumn(self.getOutputCol(), array_to_vector(damped))


def term_stages(text_col: str = "descripcion"):
    return [
        SQLTransformer(statement=keyword_sql(text_col)),
        RegexTokenizer(inputCol="_norm", outputCol="_tok", pattern=TOKEN_RX, gaps=False, minTokenLength=2),
        NGram(n=2, inputCol="_tok", outputCol="_bi"),
        SQLTransformer(statement="SELECT *, concat(_tok, _bi) AS _terms FROM __THIS__"),
    ]


def fit_features(cfg: ModelConfig, train_df: DataFrame) -> PipelineModel:
    """Text to [tf-idf, keyword scores].

    The vocabulary and its document frequencies come from one aggregation
    over the training terms: ``max_features`` most frequent terms within the
    document frequency bounds, ties alphabetical, so a refit gives the same.
    """
    text = PipelineModel(stages=term_stages())
    # every term counts once for its text and once for each of its places: sums that combine before the shuffle
    counted = lambda terms, df, cf: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf")))
    terms = text.transform(train_df.select("descripcion"))
    stats = (terms.select(F.inline(F.concat(counted(F.array_distinct("_terms"), 1, 0), counted(F.col("_terms"), 0, 1))))
                  .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    n = train_df.select(F.count(F.lit(1)).alias("n"))
    rows = vocabulary(stats, n, cfg.vocab_size, cfg.min_df, cfg.max_df if cfg.max_df is not None else 1.0).collect()
    rows = sorted(rows, key=lambda r: (-r["cf"], r["term"])) or []
    idf = [math.log((1 + r["n"]) / (1 + r["df"])) + 1 for r in rows]
    tf_col = "_tf"
    stages = [*text.stages]
    if rows:
        stages.append(CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="_terms", outputCol="_tf"))
        if cfg.sublinear_tf:
            stages.append(SublinearTF(inputCol="_tf", outputCol="_stf"))
            tf_col = "_stf"
        stages += [ElementwiseProduct(scalingVec=DenseVector(idf), inputCol=tf_col, outputCol="_tfidf"),
                   Normalizer(p=2.0, inputCol="_tfidf", outputCol="_tfidf_n")]
    inputs = (["_tfidf_n"] if rows else []) + [f"kw_{i}" for i in range(len(WEIGHTED_RULES))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages=stages)


def stratified_split(df: DataFrame, label: str = "categoria", key: str = "row_id", fraction: float = TEST_FRACTION,
                     seed: int = SEED, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """> 20 rows -> stratified hold-out, else train = test = all rows.

    The hold-out is exact per class, ``round(fraction * n_class)`` rows, at
    every size: the rows with the smallest hash of their ``key`` (where the
    frame has no such column, of their place, so copies of a text fall on
    either side).  Per class, a histogram of the hashes' leading bits gives
    the bucket where the count is reached; whole buckets before it are test
    rows, and only that bucket's rows are sorted.  No class meets in one task.
    """
    n = df.count() if n is None else n
    if n <= SPLIT_MIN_ROWS:
        return df, df
    row = F.col(key) if key in df.columns else F.monotonically_increasing_id()
    tagged = materialize(df.withColumn("_row", row).withColumn("_h", F.xxhash64("_row", F.lit(seed))))
    tagged = tagged.withColumn("_b", F.pmod("_h", F.lit(SPLIT_BUCKETS)))
    # SPLIT_BUCKETS rows at most per class
    hist = tagged.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_b")
    want = F.round(F.sum("_n").over(Window.partitionBy(label)) * fraction)
    hist = hist.select(F.col(label).alias("_label"), "_b", "_n", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), want.alias("_want"))
    edge = hist.where((F.col("_before") <= F.col("_want")) & (F.col("_before") + F.col("_n") > F.col("_want")))
    edge = materialize(edge.select("_label", F.col("_b").alias("_edge"), (F.col("_want") - F.col("_before")).alias("_more")))
    # a class whose every row is wanted has no edge
    placed = tagged.join(edge, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    sure = placed.where(F.col("_edge").isNull() | (F.col("_b") != F.col("_edge"))) \
                 .withColumn("_is_test", F.col("_edge").isNull() | (F.col("_b") < F.col("_edge")))
    last = placed.where(F.col("_b") == F.col("_edge"))
    order = Window.partitionBy(label).orderBy("_h", "_row")
    last = last.withColumn("_is_test", F.row_number().over(order) <= F.col("_more"))
    split = materialize(sure.unionByName(last).drop("_row", "_h", "_b", "_edge", "_more"))
    return split.where(~F.col("_is_test")).drop("_is_test"), split.where("_is_test").drop("_is_test")


@dataclass
class TrainResult:
    status: str
    samples: int
    model: PipelineModel | None = None
    accuracy: float | None = None
    categories: list[str] = field(default_factory=list)
    features: int | None = None
    feature_importance_mean: float | None = None
    training_time: float | None = None
    method: str = "rules"

    def summary(self, spark) -> DataFrame:
        """One-row training summary."""
        row = (self.status, float(self.accuracy) if self.accuracy is not None else None, self.samples,
               self.categories, self.features, self.feature_importance_mean, self.training_time,
               time.strftime("%Y-%m-%dT%H:%M:%S"))
        return spark.createDataFrame([row], "status string, accuracy double, samples bigint, "
                                            "categories array<string>, features int, "
                                            "feature_importance_mean double, training_time double, "
                                            "training_date string")


def train(df: DataFrame, target_column: str | None = None, cfg: ModelConfig = IMPROVED,
          text_col: str = "descripcion") -> TrainResult:
    """Labelled column or pseudo-labels (C4); < 10 rows -> rule_based."""
    # the row id decides the split, so that equal data are split alike in any partitioning
    key = ["row_id"] if "row_id" in df.columns else []
    if target_column and target_column in df.columns:
        data = df.select(*key, F.col(text_col).alias("descripcion"), F.col(target_column).alias("categoria"))
    else:
        data = pseudo_labels(df, text_col).select(*key, "descripcion", "categoria")
    data = data.where(F.col("descripcion").isNotNull() & F.col("categoria").isNotNull())
    n = data.count()
    if n < MIN_TRAINING_ROWS:
        return TrainResult("rule_based", n)
    start = time.time()
    train_df, test_df = stratified_split(data, n=n)
    indexer = StringIndexer(inputCol="categoria", outputCol="label", stringOrderType="alphabetAsc").fit(train_df)
    feats = fit_features(cfg, train_df)
    # features are computed once per distinct text; class counts and the forest read every row
    by_text = lambda model: lambda keys: model.transform(keys.withColumn("descripcion", F.col("_key")))
    prepared = materialize(score_distinct(indexer.transform(train_df), F.col("descripcion"), by_text(feats), ["features"]).select("features", "label"))
    weight_col = None
    if cfg.balanced:  # n / (k * n_class)
        n_train, k = prepared.count(), len(indexer.labels)
        per_class = prepared.groupBy("label").agg((F.lit(float(n_train)) / (F.lit(float(k)) * F.count(F.lit(1)))).alias("_w"))
        prepared = prepared.join(per_class, "label")
        weight_col = "_w"
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=cfg.num_trees,
                                maxDepth=cfg.max_depth, minInstancesPerNode=cfg.min_instances_per_node,
                                featureSubsetStrategy=cfg.feature_subset, seed=SEED, maxMemoryInMB=FOREST_MB,
                                **({"weightCol": weight_col} if weight_col else {}))
    forest = rf.fit(prepared)
    if cfg.min_samples_split > 2:
        forest = with_min_samples_split(df.sparkSession, forest, cfg.min_samples_split)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    model = PipelineModel(stages=[*feats.stages, forest, back])
    elapsed = time.time() - start
    pred = score_distinct(test_df, F.col("descripcion"), by_text(model), ["predicted"])
    acc = pred.agg(F.avg((F.col("predicted") == F.col("categoria")).cast("double"))).first()[0]
    n_feats = forest.numFeatures
    return TrainResult("trained" if cfg.method == "ml" else "trained_improved", n, model, acc,
                       list(indexer.labels), n_feats,
                       float(forest.featureImportances.toArray().mean()) if n_feats else 0.0,
                       elapsed, cfg.method)


def predict_with_confidence(model: PipelineModel | None, df: DataFrame, method: str = "ml_improved",
                            text_col: str = "descripcion", use_cache: bool = True) -> DataFrame:
    """Category, confidence = max class probability, method tag,
    feature count; an untrained model falls back to the rules (C2/C3).

    With ``use_cache`` (C7) the forest scores each distinct cache key
    (lower + strip of the text) once; otherwise every row.
    """
    if model is None:
        return categorize_weighted(df, text_col, method="rules_fallback" if method == "ml_improved" else "rules")
    n_features = model.stages[-2].numFeatures

    def score(d: DataFrame, src: str) -> DataFrame:
        # the pipeline reads "descripcion"; feed it ``src`` and keep the original column
        if src != "descripcion":
            d_in = d.withColumnRenamed("descripcion", "_desc_orig") if "descripcion" in d.columns else d
            scored = model.transform(d_in.withColumn("descripcion", F.col(src)))
            cols = [F.col("_desc_orig").alias(c) if c == "descripcion" else F.col(c) for c in d.columns]
        else:
            scored = model.transform(d)
            cols = [F.col(c) for c in d.columns]
        return scored.select(*cols,
                             F.col("predicted").alias("categoria"),
                             F.array_max(vector_to_array("probability")).alias("confidence"))
    base = df.drop(*[c for c in ("categoria", "confidence", "method", "feature_count") if c in df.columns])
    if use_cache and not df.isStreaming:
        # the scorer sees the key (lower + strip): what the cache would have scored
        out = score_distinct(base, cache_key(F.col(text_col)), lambda d: score(d, "_key"), ["categoria", "confidence"])
    else:
        out = score(base, text_col)
    return out.withColumn("method", F.lit(method)).withColumn("feature_count", F.lit(n_features))


def feature_model(model: PipelineModel) -> PipelineModel:
    """D3: the feature part of a trained model (everything before the forest)."""
    return PipelineModel(stages=model.stages[:-2])


def save_model(result: TrainResult, path: str, rules: DataFrame | None = None) -> None:
    """Pipeline and rule table (the built-in one unless given) as a new version of the bundle."""
    if result.model is None:
        raise ValueError("nothing to save: the model is rule based")
    save_bundle(SparkSession.active(), result.model, path, rules)


def load_model(path: str) -> PipelineModel | None:
    """The bundle's model; ``None`` only where nothing was saved.  A broken bundle is an error."""
    bundle = load_bundle(SparkSession.active(), path)
    return bundle.model if bundle else None


def improve_with_user_data(seed: DataFrame, user: DataFrame, cfg: ModelConfig = BASE) -> TrainResult:
    """Seed set + the user's labelled rows, then retrain."""
    if "categoria" in user.columns:
        key = ["row_id"] if "row_id" in user.columns else []
        if key:  # the user's ids are kept; the phrases, which have none, get ids below them
            low = F.least(F.lit(0).cast("bigint"), F.lit(user.agg(F.min("row_id")).first()[0] or 0))
            seed = seed.withColumn("row_id", low - 1 - F.abs(F.xxhash64("descripcion", "categoria") % (1 << 30)))
        seed = seed.unionByName(user.select(*key, "descripcion", "categoria"))
    return train(seed, "categoria", cfg)


def categorize_smart(df: DataFrame, model_path: str | None = None, cfg: ModelConfig = IMPROVED,
                     target_column: str | None = None, use_cache: bool = True) -> tuple[DataFrame, float | None]:
    """Load the model or train one on the data, then add
    ``categoria``, ``confidence`` and ``method``; ``use_cache`` scores each
    distinct text once (hits and misses: ``smart_cache_stats``)."""
    model = load_model(model_path) if model_path else None
    accuracy = None
    if model is None:
        res = train(df, target_column, cfg)
        model, accuracy = res.model, res.accuracy
        if model is not None and model_path:
            save_model(res, model_path)
    out = predict_with_confidence(model, df.drop(*[c for c in ("categoria",) if c in df.columns]), cfg.method,
                                  use_cache=use_cache)
    return out.drop("feature_count") if "feature_count" in out.columns else out, accuracy


def smart_cache_stats(df: DataFrame, use_cache: bool = True, text_col: str = "descripcion") -> DataFrame:
    """Total predictions, cache size, hits, misses and hit rate of ``categorize_smart``;
    without the cache nothing is held and nothing hit."""
    stats = cache_stats(df, text_col)
    if use_cache:
        return stats
    zero = F.lit(0).cast("bigint")
    return stats.select("total_predictions", zero.alias("cache_size"), zero.alias("cache_hits"),
                        F.col("total_predictions").alias("cache_misses"), F.lit(0.0).alias("hit_rate"))
