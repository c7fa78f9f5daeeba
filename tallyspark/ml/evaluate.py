"""Classification metrics (D12) and label codes (D4) as aggregations.

Metrics come from one ``groupBy(true, predicted).count()`` (at most
classes^2 rows), so the cost is one pass whatever the table size.
Zero divisions give 0, as in the reference report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.order import global_rank
from tallyspark.session import materialize


def label_codes(df: DataFrame, col: str = "categoria") -> DataFrame:
    """Alphabetical integer code per distinct label (0-based)."""
    labels = df.where(F.col(col).isNotNull()).select(F.col(col).alias("categoria")).distinct()
    return global_rank(labels, ["categoria"], "code").select("categoria", F.col("code").cast("int").alias("code"))


def classification_report(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Per class precision / recall / f1 / support + accuracy, macro and weighted avg."""
    pairs = materialize(df.groupBy(F.col(true_col).cast("string").alias("t"), F.col(pred_col).cast("string").alias("p"))
                          .agg(F.count(F.lit(1)).alias("n")))
    tp = pairs.where(F.col("t") == F.col("p")).select(F.col("t").alias("label"), F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"))
    pc = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("pred"))
    per = (sup.join(pc, "label", "full").join(tp, "label", "left")
              .select("label", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("support", F.lit(0)).alias("support"),
                      F.coalesce("pred", F.lit(0)).alias("pred")))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.select("label", "support", "tp", prec.alias("precision"), rec.alias("recall"))
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall")
                                            / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), (F.col("tp") / F.col("n")).alias("precision"),
                     (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1_score"),
                     F.col("n").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("n").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), (F.col("wp") / F.col("n")).alias("precision"),
                          (F.col("wr") / F.col("n")).alias("recall"), (F.col("wf") / F.col("n")).alias("f1_score"),
                          F.col("n").alias("support"))
    out = per.select("label", "precision", "recall", "f1_score", "support")
    out = out.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"))


def evaluation_triples(df: DataFrame, text_col: str, true_col: str, pred_col: str) -> DataFrame:
    """The (text, true, predicted) listing of the evaluation."""
    return df.select(F.col(text_col).alias("descripcion"), F.col(true_col).alias("real"),
                     F.col(pred_col).alias("predicha"))
