"""Rule-based categorisation.

The rule tables are fixed and small (76 / 174 keywords).  Scoring is a
built-in expression (``contains`` per keyword, one int column per
keyword, summed per category) on every row: a narrow projection without
a shuffle, a join or a Python UDF, the same at every size and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.constants import (DEFAULT_CATEGORY, FIRST_MATCH_RULES, PSEUDO_LABEL_MIN_SCORE,
                                  RULE_NO_MATCH_CONFIDENCE, RULE_SCORE_SCALE, WEIGHTED_RULES,
                                  weight_tenths)
from tallyspark.functions.text import normalize_for_matching
from tallyspark.operators.clean import compute_once
from tallyspark.session import materialize


def first_match_category(desc: Column, rules=FIRST_MATCH_RULES) -> Column:
    """First category (in rule order) with a keyword inside the lower-cased text."""
    text = desc
    out = None
    for category, keywords in rules:
        if not keywords:
            continue
        hit = None
        for kw in keywords:
            h = text.contains(kw)
            hit = h if hit is None else (hit | h)
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    return out.otherwise(F.lit(DEFAULT_CATEGORY))


def category_scores_tenths(norm: Column, rules=WEIGHTED_RULES) -> list[tuple[str, Column]]:
    """C5 in exact integer tenths: per category, matched keywords x weight."""
    out = []
    for category, weight, keywords in rules:
        hits = [norm.contains(kw).cast("int") for kw in keywords]
        out.append((category, sum(hits[1:], hits[0]) * weight_tenths(weight)))
    return out


def _keyword_hits(df: DataFrame, norm_col: str, rules=WEIGHTED_RULES) -> DataFrame:
    """One int column per keyword, computed once (small generated methods)."""
    cols = {f"_k{i}_{j}": F.col(norm_col).contains(kw).cast("int")
            for i, (_, _, kws) in enumerate(rules) for j, kw in enumerate(kws)}
    return compute_once(df.select("*", *[c.alias(n) for n, c in cols.items()]), *cols)


def best_category_struct(df: DataFrame, norm_col: str = "_norm", rules=WEIGHTED_RULES) -> DataFrame:
    """Adds ``_best`` = (category, score_tenths): highest score, ties to the
    earlier category, no match -> Otros.  Score and category ordinal are
    packed into one integer so ``greatest`` picks both at once."""
    hits = _keyword_hits(df, norm_col, rules)
    n = len(rules)
    packed = []
    for i, (_, w, kws) in enumerate(rules):
        cnt = sum((F.col(f"_k{i}_{j}") for j in range(1, len(kws))), F.col(f"_k{i}_0"))
        packed.append(cnt * weight_tenths(w) * (n + 1) + (n - i))
    best = F.greatest(*packed)
    score = (best / (n + 1)).cast("int")
    names = F.array(*[F.lit(c) for c, _, _ in rules])
    category = F.when(score > 0, F.element_at(names, (F.lit(n + 1) - best % (n + 1)).cast("int"))) \
                .otherwise(F.lit(DEFAULT_CATEGORY))
    keep = [c for c in df.columns]
    return hits.select(*keep, F.struct(category.alias("category"), score.alias("score_tenths")).alias("_best"))


def categorize_first_match(df: DataFrame, out_col: str = "categoria", text_col: str = "descripcion") -> DataFrame:
    """C1 as a transform."""
    scored = df.drop(out_col).withColumn("_text", F.lower(F.col(text_col).cast("string")))
    scored = compute_once(scored, "_text")
    return scored.withColumn(out_col, first_match_category(F.col("_text"))).drop("_text")


def weighted_rule_columns(df: DataFrame, text_col: str = "descripcion") -> DataFrame:
    """Adds ``_norm``, ``_best`` (category, score_tenths) helper columns,
    each computed once per row."""
    df = df.drop("_norm", "_best").withColumn("_norm", normalize_for_matching(F.col(text_col)))
    return compute_once(best_category_struct(compute_once(df, "_norm")), "_best")


def categorize_weighted(df: DataFrame, text_col: str = "descripcion",
                        out_col: str = "categoria", with_confidence: bool = True,
                        method: str = "rules") -> DataFrame:
    """C2 + C3: category, confidence = min(score / 5, 1) or 0.1, method tag."""
    df = weighted_rule_columns(df, text_col)
    df = df.withColumn(out_col, F.col("_best.category"))
    if with_confidence:
        score = F.col("_best.score_tenths")
        conf = F.when(score > 0, F.least(score / F.lit(10.0 * RULE_SCORE_SCALE), F.lit(1.0))) \
                .otherwise(F.lit(RULE_NO_MATCH_CONFIDENCE))
        df = df.withColumn("confidence", conf).withColumn("method", F.lit(method))
    return df.drop("_norm", "_best")


def rule_score(df: DataFrame, text_col: str = "descripcion") -> DataFrame:
    """C2 with the raw score (weights summed) exposed as ``score``."""
    df = weighted_rule_columns(df, text_col)
    return (df.withColumn("categoria", F.col("_best.category"))
              .withColumn("score", F.col("_best.score_tenths") / F.lit(10.0))
              .drop("_norm", "_best"))


def pseudo_labels(df: DataFrame, text_col: str = "descripcion",
                  min_score: float = PSEUDO_LABEL_MIN_SCORE) -> DataFrame:
    """C4: (descripcion, categoria, confidence=raw score) where score > 1.0, with ``row_id`` if there is one."""
    scored = rule_score(df, text_col)
    key = ["row_id"] if "row_id" in df.columns else []
    return (scored.where(F.col("score") > F.lit(min_score))
                  .select(*key, F.col(text_col).alias("descripcion"), "categoria",
                          F.col("score").alias("confidence")))


def keyword_features(df: DataFrame, text_col: str = "descripcion",
                     prefix: str = "kw_") -> DataFrame:
    """One column per category = matches x weight (as double)."""
    norm = normalize_for_matching(F.col(text_col))
    cols = [(s / F.lit(10.0)).alias(f"{prefix}{i}")
            for i, (_, s) in enumerate(category_scores_tenths(norm))]
    return df.select("*", *cols)


def category_distribution(df: DataFrame, col: str = "categoria") -> DataFrame:
    """Counts and percentages of non-missing categories."""
    if col not in df.columns:
        df = categorize_weighted(df, out_col=col, with_confidence=False)
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    counts = materialize(counts)  # the total reads the counts, not the rows again
    total = counts.agg(F.sum("count").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(
        F.col(col).alias("categoria"), "count", (F.col("count") * 100.0 / F.col("_all")).alias("percentage"))
