"""Rules as a table (C1-C3 for any number of keywords).

``rules`` scores a fixed set with one int column per keyword; a table of thousands of keywords needs
another plan.  A keyword without a blank lies inside one word of a text, so the distinct words of all texts
are scored once, and each text then collects the rules of its words; keywords with blanks are looked for in
whole texts.  Each keyword is filed under one anchor, a rare one of its 6-grams (3-grams below six
characters, itself below three).  A word that contains the keyword contains its anchor, so an equi-join of
the words' grams with the anchors finds every possible hit once, and ``contains`` confirms it.  The plan has
the same size for any number of keywords.  Tables of keywords, words and hits are shuffled, never
broadcast, since their size can't be told from that of the files they come from; Spark splits a hot one.

A rule table has (category, ord, weight_tenths, keyword); several categories may share a keyword, ties go
to the lower ``ord``.  Rules without a keyword match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import DEFAULT_CATEGORY, FIRST_MATCH_RULES, RULE_NO_MATCH_CONFIDENCE, RULE_SCORE_SCALE, WEIGHTED_RULES, weight_tenths
from tallyspark.functions.text import normalize_for_matching
from tallyspark.operators.reuse import score_distinct
from tallyspark.session import materialize

SHORT, LONG = 3, 6  # characters of an anchor
BUCKETS = 1 << 16  # grams are counted by hash; an anchor need not be the rarest
SCHEMA = "category string, ord int, weight_tenths int, keyword string"


def weighted_rules(spark: SparkSession, rules=WEIGHTED_RULES) -> DataFrame:
    return spark.createDataFrame([(c, i, weight_tenths(w), k) for i, (c, w, ks) in enumerate(rules) for k in ks], SCHEMA)


def first_match_rules(spark: SparkSession, rules=FIRST_MATCH_RULES) -> DataFrame:
    return spark.createDataFrame([(c, i, 0, k) for i, (c, ks) in enumerate(rules) for k in ks], SCHEMA)


def grams(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters, size >= 1; none in a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, size)))


def anchored(rules: DataFrame) -> DataFrame:
    """Distinct keywords with the gram that files them, one that few keywords share."""
    keywords = rules.where(F.length("keyword") > 0).select("keyword").distinct()
    n = F.length("keyword")
    filed = keywords.withColumn("_grams", grams(F.col("keyword"), F.when(n >= LONG, F.lit(LONG)).otherwise(F.least(n, F.lit(SHORT)))))
    filed = filed.select("keyword", F.explode("_grams").alias("gram")).withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)))
    counts = filed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))  # at most BUCKETS rows
    return filed.join(F.broadcast(counts), "_bucket").groupBy("keyword").agg(F.min(F.struct("n", "gram")).alias("best")).select("keyword", F.col("best.gram").alias("gram"))


def found_in(texts: DataFrame, text_col: str, anchors: DataFrame, sizes: list[int]) -> DataFrame:
    """The columns of ``texts`` but the text, and ``keyword``: every keyword of ``anchors`` that the text contains, once."""
    every = F.flatten(F.array(*[grams(F.col(text_col), F.lit(n)) for n in sizes]))
    cut = texts.select("*", F.explode(every).alias("gram"))
    return cut.join(anchors.hint("merge"), "gram").where(F.contains(F.col(text_col), F.col("keyword")))


def hits(texts: DataFrame, text_col: str, rules: DataFrame, key: list[str]) -> DataFrame:
    """(key, category, ord, weight_tenths): every rule whose keyword the text contains, once."""
    # written once, each row with a number of its own
    rules = materialize(rules.where(F.length("keyword") > 0).withColumn("_rule", F.monotonically_increasing_id()))
    anchors = materialize(anchored(rules).withColumn("_blank", F.contains("keyword", F.lit(" "))))
    forms = anchors.select("_blank", F.length("gram")).distinct().collect()  # at most 2 x 4
    columns, parts = ["category", "ord", "weight_tenths"], []
    if sizes := sorted(n for blank, n in forms if not blank):
        words = texts.select(*key, F.explode(F.array_distinct(F.split(text_col, " "))).alias("_word"))
        found = found_in(words.select("_word").distinct(), "_word", anchors.where("not _blank"), sizes).select("_word", "keyword")
        hit = F.struct("_rule", *columns).alias("_hit")
        by_word = found.join(rules.hint("merge"), "keyword").groupBy("_word").agg(F.collect_list(hit).alias("_hits"))
        dealt = words.join(by_word.hint("merge"), "_word").select(*key, "_hits").repartition(*key)
        parts.append(dealt.select(*key, F.explode("_hits").alias("_hit")).select(*key, "_hit.*").distinct().select(*key, *columns))
    if sizes := sorted(n for blank, n in forms if blank):
        found = found_in(texts.select(*key, text_col), text_col, anchors.where("_blank"), sizes).select(*key, "keyword")
        parts.append(found.join(rules.hint("merge"), "keyword").select(*key, *columns))
    return reduce(DataFrame.unionByName, parts) if parts else texts.select(*key).join(rules.select(*columns), F.lit(False))


def best_rule(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """C2 for distinct texts ``_key``: category, and the sum of weights in tenths (0: no match)."""
    norm = keys.withColumn("_text", normalize_for_matching(F.col("_key")))
    score = hits(norm, "_text", rules, ["_h1", "_h2"]).groupBy("_h1", "_h2", "ord", "category").agg(F.sum("weight_tenths").alias("tenths"))
    best = score.groupBy("_h1", "_h2").agg(F.max(F.struct("tenths", (-F.col("ord")).alias("first"), "category")).alias("_best"))
    return keys.join(best, ["_h1", "_h2"], "left").select(
        *keys.columns, F.when(F.col("_best.tenths") > 0, F.col("_best.category")).otherwise(F.lit(DEFAULT_CATEGORY)).alias("categoria"),
        F.coalesce(F.col("_best.tenths"), F.lit(0)).cast("int").alias("score_tenths"))


def categorize_by_rules(df: DataFrame, rules: DataFrame, text_col: str = "descripcion", method: str = "rules") -> DataFrame:
    """C2 + C3 over a rule table: category, confidence and method, each distinct text scored once."""
    base = df.drop("categoria", "confidence", "method")
    out = score_distinct(base, F.coalesce(F.col(text_col).cast("string"), F.lit("")), lambda keys: best_rule(keys, rules), ["categoria", "score_tenths"])
    score = F.col("score_tenths")
    confidence = F.when(score > 0, F.least(score / F.lit(10.0 * RULE_SCORE_SCALE), F.lit(1.0))).otherwise(F.lit(RULE_NO_MATCH_CONFIDENCE))
    return out.withColumn("confidence", confidence).withColumn("method", F.lit(method)).drop("score_tenths")


def first_match_by_rules(df: DataFrame, rules: DataFrame, text_col: str = "descripcion") -> DataFrame:
    """C1 over a rule table: the category of the lowest ``ord`` with a keyword in the lower-cased text."""
    def score(keys: DataFrame) -> DataFrame:
        lower = keys.withColumn("_text", F.lower("_key"))
        best = hits(lower, "_text", rules, ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.min_by("category", "ord").alias("_best"))
        return keys.join(best, ["_h1", "_h2"], "left").select(*keys.columns, F.coalesce("_best", F.lit(DEFAULT_CATEGORY)).alias("categoria"))

    return score_distinct(df.drop("categoria"), F.coalesce(F.col(text_col).cast("string"), F.lit("")), score, ["categoria"])
