"""Aggregations, top-k and summaries.

Every grouped aggregate is a hash aggregation with a partial step, so a
category (or any key) holding a third of the rows is combined map-side
before the shuffle.  Windows only ever run over already-aggregated
tables (one row per group) or as top-k with a per-partition limit
(``WindowGroupLimit``) below the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.constants import (ADVICE_LARGE, ADVICE_MANY_CATEGORIES, LARGE_DATASET_ROWS,
                                  MANY_CATEGORIES, TOP_EXPENSES, TOP_PER_CATEGORY, TREND_DAYS)
from tallyspark.functions.money import format_amount
from tallyspark.operators.stats import exact_median
from tallyspark.session import materialize

MONEY = 2   # money results are rounded to cents (sums of doubles vary with order)
RATIO = 6


def _r(c, d=MONEY):
    return F.round(c, d)


def overall(df: DataFrame, amount: str = "monto") -> DataFrame:
    """Count, sum, mean, median."""
    med = exact_median(df, amount)
    return df.agg(F.count(F.lit(1)).alias("total_gastos"),
                  _r(F.sum(amount)).alias("monto_total"),
                  _r(F.avg(amount)).alias("monto_promedio"),
                  _r(F.lit(med).cast("double")).alias("monto_mediano"))


def by_category(df: DataFrame, cat: str = "categoria", amount: str = "monto") -> DataFrame:
    """Sum, count, mean per category."""
    return df.groupBy(F.col(cat).alias("categoria")).agg(
        _r(F.sum(amount)).alias("sum"), F.count(F.lit(1)).alias("count"),
        _r(F.avg(amount)).alias("mean"))


def period(df: DataFrame, date: str = "fecha") -> DataFrame:
    """First date, last date and whole days between (floored)."""
    # whole days on wall-clock values: no session-time-zone (DST) shift
    out = df.agg(F.min(date).alias("fecha_inicio"), F.max(date).alias("fecha_fin"))
    return out.withColumn("dias_total", F.expr("timestampdiff(DAY, fecha_inicio, fecha_fin)").cast("bigint"))


def monthly(df: DataFrame, date: str = "fecha", amount: str = "monto") -> DataFrame:
    """Sums keyed by (year, month); rows without a date drop out."""
    return (df.where(F.col(date).isNotNull())
              .groupBy(F.year(date).alias("año"), F.month(date).alias("mes"))
              .agg(_r(F.sum(amount)).alias("monto")))


def top_n(df: DataFrame, n: int = TOP_EXPENSES, amount: str = "monto",
          cols: tuple[str, ...] = ("descripcion", "monto", "categoria"),
          order_col: str = "row_id") -> DataFrame:
    """E5: top-n by amount, ties in input order (TakeOrderedAndProject)."""
    return (df.orderBy(F.col(amount).desc(), F.col(order_col).asc())
              .limit(n).select(order_col, *[c for c in cols if c != order_col]))


def daily(df: DataFrame, date: str = "fecha", amount: str = "monto") -> DataFrame:
    """Daily sums, NULL dates dropped."""
    return (df.where(F.col(date).isNotNull())
              .groupBy(F.to_date(date).alias("fecha"))
              .agg(_r(F.sum(amount)).alias("monto")))


def trend(df: DataFrame, days: int = TREND_DAYS, date: str = "fecha",
          amount: str = "monto") -> DataFrame:
    """Last ``days`` before the latest date vs everything before.

    The latest date is a one-row aggregate, broadcast to every partition;
    the two conditional sums run in a single aggregation.
    """
    cutoff = df.agg((F.max(date) - F.make_dt_interval(F.lit(days))).alias("_cutoff"))
    j = df.select(date, amount).crossJoin(F.broadcast(cutoff))
    agg = j.agg(F.sum(F.when(F.col(date) > F.col("_cutoff"), F.col(amount))).alias("recent"),
                F.sum(F.when(F.col(date) <= F.col("_cutoff"), F.col(amount))).alias("previous"))
    recent = F.coalesce(F.col("recent"), F.lit(0.0))
    previous = F.coalesce(F.col("previous"), F.lit(0.0))
    pct = F.when(previous > 0, (recent - previous) / previous * 100).otherwise(F.lit(0.0))
    return agg.select(_r(recent).alias("recent_total"), _r(previous).alias("previous_total"),
                      _r(pct, RATIO).alias("trend_percentage"))


def category_insights(df: DataFrame, top: int = TOP_PER_CATEGORY, cat: str = "categoria",
                      amount: str = "monto", order_col: str = "row_id") -> DataFrame:
    """Per category total, count, mean, % of grand total and top rows.

    Long form: one row per (category, rank).  The top-k window is
    filtered by rank, so Spark limits each map partition to ``top`` rows
    per category before the shuffle (``WindowGroupLimit``); the category
    statistics are a partial/final hash aggregation.  The four columns that
    are needed are written once and read by both.  Rows without a category
    form one of their own (NULL).
    """
    df = materialize(df.select(cat, "descripcion", amount, order_col))
    stats = df.groupBy(cat).agg(F.sum(amount).alias("_total"), F.count(F.lit(1)).alias("transaction_count"),
                                F.avg(amount).alias("_avg"))
    grand = df.agg(F.sum(amount).alias("_grand"))  # one row
    stats = stats.crossJoin(F.broadcast(grand)).select(F.col(cat).alias("categoria"), _r(F.col("_total")).alias("total_amount"), "transaction_count",
                         _r(F.col("_avg")).alias("average_amount"),
                         _r(F.col("_total") / F.col("_grand") * 100, RATIO).alias("percentage_of_total"))
    w = Window.partitionBy(cat).orderBy(F.col(amount).desc(), F.col(order_col).asc())
    tops = (df.select(cat, "descripcion", amount, order_col)
              .withColumn("top_rank", F.row_number().over(w))
              .where(F.col("top_rank") <= top)
              .select(F.col(cat).alias("_cat"), "top_rank", F.col("descripcion").alias("top_descripcion"),
                      F.col(amount).alias("top_monto")))
    return stats.join(tops, F.col("categoria").eqNullSafe(F.col("_cat"))).drop("_cat")


def summary_stats(df: DataFrame, amount: str = "monto") -> DataFrame:
    """Count, sum, mean, median, max, min, sample std + money text."""
    med = exact_median(df, amount)
    base = df.agg(F.count(F.lit(1)).alias("total_transactions"),
                  _r(F.sum(amount)).alias("total_amount"),
                  _r(F.avg(amount)).alias("average_transaction"),
                  _r(F.lit(med).cast("double")).alias("median_transaction"),
                  F.max(amount).alias("max_transaction"),
                  F.min(amount).alias("min_transaction"),
                  _r(F.stddev_samp(amount)).alias("std_transaction"))
    for k in ("total_amount", "average_transaction", "median_transaction",
              "max_transaction", "min_transaction"):
        base = base.withColumn(f"{k}_formatted", format_amount(F.col(k)))
    return base


def category_share(df: DataFrame, cat: str = "categoria", amount: str = "monto") -> DataFrame:
    """Sum per category (the pie)."""
    return df.groupBy(F.col(cat).alias("categoria")).agg(_r(F.sum(amount)).alias("monto"))


def category_table(df: DataFrame, cat: str = "categoria", amount: str = "monto") -> DataFrame:
    """Total / Cantidad / Promedio rounded half-even to 2, ascending."""
    return (df.groupBy(F.col(cat).alias("categoria"))
              .agg(F.bround(F.sum(amount), 2).alias("Total"), F.count(F.lit(1)).alias("Cantidad"),
                   F.bround(F.avg(amount), 2).alias("Promedio"))
              .orderBy("Total"))


def kpis(df: DataFrame, cat: str = "categoria", amount: str = "monto") -> DataFrame:
    """Count, sum, mean, distinct categories."""
    return df.agg(F.count(F.lit(1)).alias("transacciones"), _r(F.sum(amount)).alias("total"),
                  _r(F.avg(amount)).alias("promedio"),
                  F.count_distinct(cat).alias("categorias"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of a column's non-missing values, descending."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc()))


def dataset_profile(df: DataFrame, cat: str = "categoria",
                    large_rows: int = LARGE_DATASET_ROWS,
                    many_categories: int = MANY_CATEGORIES) -> DataFrame:
    """Row count, distinct categories and the two advice flags."""
    base = df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.count_distinct(cat).alias("category_count"))
    large = F.col("row_count") > large_rows
    many = F.col("category_count") > many_categories
    advice = F.array_compact(F.array(F.when(large, F.lit(ADVICE_LARGE)), F.when(many, F.lit(ADVICE_MANY_CATEGORIES))))
    return base.select("*", large.alias("large_dataset"), many.alias("many_categories"),
                       F.array_join(advice, " | ").alias("recommendations"))
