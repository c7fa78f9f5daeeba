"""Presentation transforms (B14-B20): filters, bands, overrides, styling, preview."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import (AUTO_CHOICE, CATEGORY_STYLE, CONF_HIGH, CONF_LOW, UNCATEGORISED)
from tallyspark.functions.dates import in_range, preset_ranges, ts_lit
from tallyspark.functions.money import format_percent
from tallyspark.operators.rules import categorize_weighted

PREVIEW_COLS = ("fecha", "descripcion", "monto", "categoria_ia", "confianza_ia")


def filter_expenses(df: DataFrame, categories=None, start=None, end=None,
                    min_amount=None, max_amount=None, cat: str = "categoria") -> DataFrame:
    """Category IN, date BETWEEN and amount BETWEEN (each optional).

    Plain predicates, so they reach the Parquet scan when the columns
    come straight from it.
    """
    cond = F.lit(True)
    if categories is not None:
        cond = cond & F.col(cat).isin(list(categories))
    if start is not None:
        cond = cond & (F.col("fecha") >= ts_lit(start))
    if end is not None:
        cond = cond & (F.col("fecha") <= ts_lit(end))
    if min_amount is not None:
        cond = cond & (F.col("monto") >= F.lit(float(min_amount)))
    if max_amount is not None:
        cond = cond & (F.col("monto") <= F.lit(float(max_amount)))
    return df.where(cond)


def preset_totals(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Rows and spend in each preset range, one pass over the data.

    Six conditional aggregates in one aggregation, then ``stack`` turns
    the single row into one row per preset.
    """
    ranges = preset_ranges(as_of)
    aggs = []
    for i, (_, s, e) in enumerate(ranges):
        hit = in_range(F.col("fecha"), s, e)
        aggs += [F.count_if(hit).alias(f"n{i}"),
                 F.round(F.coalesce(F.sum(F.when(hit, F.col("monto"))), F.lit(0.0)), 2).alias(f"t{i}")]
    one = df.agg(*aggs)
    parts = ", ".join(f"'{name}', timestamp_ntz'{s:%Y-%m-%d %H:%M:%S}', "
                      f"timestamp_ntz'{e:%Y-%m-%d %H:%M:%S}', n{i}, t{i}"
                      for i, (name, s, e) in enumerate(ranges))
    return one.selectExpr(f"stack({len(ranges)}, {parts}) as (preset, desde, hasta, n, total)")


def confidence_band(c, high: float = CONF_HIGH, low: float = CONF_LOW):
    """Alta (> high), baja (< low), media otherwise."""
    return F.when(c > high, F.lit("alta")).when(c < low, F.lit("baja")).otherwise(F.lit("media"))


def apply_manual_category(df: DataFrame, manual_col: str = "categoria_manual",
                          auto: bool = True) -> DataFrame:
    """A manual choice wins with confidence 1.0 (an icon before it is
    removed, a text without one is used as it is); blank or no choice:
    otherwise the weighted rules decide; with ``auto`` off every row is
    ``Sin categorizar`` with confidence 0.0."""
    if not auto:
        return df.withColumn("categoria_ia", F.lit(UNCATEGORISED)).withColumn("confianza_ia", F.lit(0.0))
    scored = categorize_weighted(df, out_col="_pred")
    manual = F.col(manual_col)
    is_manual = F.coalesce((F.trim(manual) != "") & (manual != F.lit(AUTO_CHOICE)), F.lit(False))
    # "<icon> <category>": an icon holds no letter or digit
    name = F.trim(F.regexp_replace(manual, r"^[^\p{L}\p{N}\s]+\s+", ""))
    return (scored.withColumn("categoria_ia", F.when(is_manual, name).otherwise(F.col("_pred")))
                  .withColumn("confianza_ia", F.when(is_manual, F.lit(1.0)).otherwise(F.col("confidence")))
                  .drop("_pred", "confidence", "method"))


def style_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORY_STYLE, "categoria string, color string, icon string")


def with_style(df: DataFrame, cat: str = "categoria") -> DataFrame:
    """Attach colour and icon; the 9-row dimension is broadcast."""
    style = F.broadcast(style_table(df.sparkSession).withColumnRenamed("categoria", cat))
    return df.join(style, cat, "left")


def preview(df: DataFrame, n: int = 10, cols=PREVIEW_COLS, order_col: str = "row_id") -> DataFrame:
    """The available preview columns, first ``n`` rows in input order."""
    have = [c for c in cols if c in df.columns]
    return df.orderBy(order_col).limit(n).select(order_col, *have)


def display_columns(df: DataFrame, money_decimals: int = 2) -> DataFrame:
    """ISO date text, money text, percent text."""
    out = df.withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))
    out = out.withColumn("monto", F.concat(F.lit("$"), F.format_number("monto", money_decimals)))
    if "confianza_ia" in df.columns:
        out = out.withColumn("confianza_ia", format_percent(F.col("confianza_ia")))
    return out
