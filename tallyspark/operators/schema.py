"""Column standardisation.

The rename plan is computed on the driver from ``df.columns`` (names
only); the single data-dependent decision -- which columns are numeric,
for the fallback -- is one aggregation over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.constants import COLUMN_SYNONYMS
from tallyspark.functions.money import NUMBER_RX

REQUIRED = ("descripcion", "monto")


def rename_plan(columns: list[str], synonyms=COLUMN_SYNONYMS) -> dict[str, str]:
    """Lower/strip names; per standard name, the first column (file order)
    whose name contains a synonym.  A later standard name overwrites an
    earlier mapping of the same column (``fecha_valor`` -> ``monto``)."""
    names = [c.lower().strip() for c in columns]
    mapping: dict[str, str] = {}
    for std, variants in synonyms:
        for n in names:
            if any(v in n for v in variants):
                mapping[n] = std
                break
    return mapping


def _numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose every non-null value is a number (one aggregation)."""
    checks, direct = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            direct.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            c = F.trim(F.col(f"`{f.name}`"))
            checks.append(F.count_if(c.isNotNull() & ~c.rlike(NUMBER_RX)).alias(f.name))
    bad = df.agg(*checks).first().asDict() if checks else {}
    return [f.name for f in df.schema.fields if f.name in direct or bad.get(f.name, 1) == 0]


def standardize_columns(df: DataFrame, synonyms=COLUMN_SYNONYMS) -> DataFrame:
    lowered = [c.lower().strip() for c in df.columns]
    plan = rename_plan(df.columns, synonyms)
    final = [plan.get(n, n) for n in lowered]
    cols, seen = [], set()
    mapped_targets = set(plan.values())
    for orig, n, out in zip(df.columns, lowered, final):
        # two columns with one name: keep the mapped one, leave the other out
        if out in seen or (out in mapped_targets and n not in plan and out == n):
            continue
        seen.add(out)
        cols.append(F.col(f"`{orig}`").alias(out))
    res = df.select(*cols)
    missing = [c for c in REQUIRED if c not in res.columns]
    if missing:
        text_cols, numeric_cols = [], []
        numeric = set(_numeric_columns(res))
        for f in res.schema.fields:
            if isinstance(f.dataType, T.StringType) and f.name not in numeric:
                text_cols.append(f.name)
            if f.name in numeric:
                numeric_cols.append(f.name)
        if "descripcion" in missing and text_cols:
            res = res.withColumn("descripcion", F.col(f"`{text_cols[0]}`"))
        if "monto" in missing and numeric_cols:
            res = res.withColumn("monto", F.col(f"`{numeric_cols[0]}`"))
    return res
