"""Data quality (E12) and schema narrowing.

Both are one aggregation over the table: every count is a conditional
sum, so the whole report costs a single scan.  Duplicate rows are counted
on 128-bit fingerprints of the rows, 16 bytes each in the shuffle; distinct
texts per column by mergeable sketches, exactly only where the sketch
cannot decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.constants import (MSG_DUPLICATES, MSG_EMPTY_DESCRIPTIONS, MSG_INVALID_AMOUNTS,
                                  MSG_INVALID_DATES, MSG_MISSING_COLUMNS, MSG_NEGATIVE_AMOUNTS,
                                  MSG_ZERO_AMOUNTS)
from tallyspark.functions.dates import parse_date
from tallyspark.functions.money import _to_double


def typed_view(raw: DataFrame) -> DataFrame:
    """The raw table with typed amount/date but no cleaning (input of E12)."""
    out = raw
    if "monto" in raw.columns and isinstance(raw.schema["monto"].dataType, T.StringType):
        out = out.withColumn("monto", _to_double(F.trim(F.col("monto"))))
    if "fecha" in raw.columns and isinstance(raw.schema["fecha"].dataType, T.StringType):
        out = out.withColumn("fecha", parse_date(F.col("fecha")))
    return out


def fingerprint(cols: list[str]) -> list[F.Column]:
    """Two 64-bit hashes of a row.  A hash skips nulls, so which columns are null is hashed as well."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols])
    return [F.xxhash64(F.lit(k), nulls, *cols) for k in (1, 2)]


def validate(df: DataFrame, required=("descripcion", "monto"),
             dup_cols: list[str] | None = None) -> DataFrame:
    """Issues, warnings, counts and score = max(0, 100 - 20*issues - 5*warnings)."""
    missing = [c for c in required if c not in df.columns]
    dup_cols = dup_cols or [c for c in df.columns if c != "row_id"]
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(*fingerprint(dup_cols)).alias("_distinct")]
    zero = F.lit(0).cast("bigint")
    has = set(df.columns)
    aggs.append((F.count_if(F.col("descripcion").isNull()) if "descripcion" in has else zero)
                .alias("empty_descriptions"))
    if "monto" in has:
        m = F.col("monto")
        aggs += [F.count_if(m.isNull() | F.isnan(m)).alias("invalid_amounts"),
                 F.count_if(m < 0).alias("negative_amounts"), F.count_if(m == 0).alias("zero_amounts")]
    else:
        aggs += [zero.alias("invalid_amounts"), zero.alias("negative_amounts"), zero.alias("zero_amounts")]
    aggs.append((F.count_if(F.col("fecha").isNull()) if "fecha" in has else zero).alias("invalid_dates"))
    base = df.agg(*aggs).withColumn("duplicate_rows", F.col("row_count") - F.col("_distinct")).drop("_distinct")

    def msg(tpl, col):
        head, tail = tpl.split("{}")
        return F.when(F.col(col) > 0, F.concat(F.lit(head), F.col(col).cast("string"), F.lit(tail)))
    warnings = F.array_compact(F.array(
        msg(MSG_EMPTY_DESCRIPTIONS, "empty_descriptions"), msg(MSG_INVALID_AMOUNTS, "invalid_amounts"),
        msg(MSG_NEGATIVE_AMOUNTS, "negative_amounts"), msg(MSG_ZERO_AMOUNTS, "zero_amounts"),
        msg(MSG_INVALID_DATES, "invalid_dates"), msg(MSG_DUPLICATES, "duplicate_rows")))
    issues = [MSG_MISSING_COLUMNS.format(missing)] if missing else []
    out = base.withColumn("warnings", warnings)
    out = out.withColumn("issues", F.array(*[F.lit(i) for i in issues]).cast("array<string>"))
    score = F.greatest(F.lit(0), F.lit(100 - 20 * len(issues)) - F.size("warnings") * 5)
    return out.select(F.lit(len(issues) == 0).alias("valid"), "issues", "warnings", "row_count",
                      score.alias("data_quality_score"), "empty_descriptions", "invalid_amounts",
                      "negative_amounts", "zero_amounts", "invalid_dates", "duplicate_rows")


INT_TYPES = [("int8", "tinyint", -2**7, 2**7 - 1), ("int16", "smallint", -2**15, 2**15 - 1),
             ("int32", "int", -2**31, 2**31 - 1), ("int64", "bigint", -2**63, 2**63 - 1)]


SKETCH_BITS = 12
SKETCH_ERROR = 5 * 1.04 / 2 ** (SKETCH_BITS / 2)  # five standard errors


def narrowing_plan(df: DataFrame, distinct_ratio: float = 0.5) -> DataFrame:
    """Type choice per column from one aggregation.

    The distinct values of text columns are estimated by sketches in the same aggregation; a column
    whose estimate lies within SKETCH_ERROR of the ratio is then counted exactly, on its own.

    text with distinct/rows < 0.5 -> category; integers -> smallest
    signed type holding [min, max]; floats -> float32 when every value
    survives the round trip (within 1e-8), else unchanged.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    kinds = {}
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, T.StringType):
            kinds[f.name] = "text"
            aggs.append(F.hll_sketch_estimate(F.hll_sketch_agg(c, SKETCH_BITS)).alias(f"{f.name}__d"))
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            kinds[f.name] = "int"
            aggs += [F.min(c).alias(f"{f.name}__lo"), F.max(c).alias(f"{f.name}__hi")]
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            kinds[f.name] = "float"
            aggs.append(F.count_if(F.abs(c.cast("float").cast("double") - c) > 1e-8).alias(f"{f.name}__bad"))
        else:
            kinds[f.name] = "other"
    row = df.agg(*aggs).first()
    n = row["_n"]
    plan = []
    for f in df.schema.fields:
        k, name = kinds[f.name], f.name
        src = f.dataType.simpleString()
        if k == "text":
            ratio = (row[f"{name}__d"] or 0) / n if n else 0.0
            if abs(ratio - distinct_ratio) <= SKETCH_ERROR * max(ratio, distinct_ratio):
                ratio = df.agg(F.count_distinct(name)).first()[0] / n if n else 0.0
            choice = "category" if n and ratio < distinct_ratio else src
        elif k == "int":
            lo, hi = row[f"{name}__lo"], row[f"{name}__hi"]
            choice = src
            if lo is not None:
                for _, spark_t, a, b in INT_TYPES:
                    if a <= lo and hi <= b:
                        choice = spark_t
                        break
        elif k == "float":
            choice = "float" if row[f"{name}__bad"] == 0 and src == "double" else src
        else:
            choice = src
        plan.append((name, src, choice))
    return df.sparkSession.createDataFrame(plan, "column string, source_type string, chosen_type string")


def narrow(df: DataFrame) -> DataFrame:
    """Apply a narrowing plan (categoricals stay strings; Parquet
    dictionary-encodes them on write)."""
    plan = {r["column"]: r["chosen_type"] for r in narrowing_plan(df).collect()}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if plan[c] not in ("category",) and plan[c] !=
                       df.schema[c].dataType.simpleString() else F.col(c) for c in df.columns])
