"""Driver test tables and the derived transaction view.

``expenses_raw`` turns ``orders`` into a messy transaction table
(string date, description and amount with injected defects); every
row of ``orders`` is used, the modulo tests only choose which defect a
row carries.  The same view is written in DuckDB SQL in
``tallyspark.plans.oracle`` for the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import DERIVED_PHRASES
from tallyspark.session import table_path


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def expenses_raw(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    """row_id bigint, fecha string, descripcion string, monto string.

    Amounts are coarse, so that de-duplication drops rows; with ``fine``
    (bench) they differ by cents and nearly all rows stay.
    """
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    merchant = F.element_at(F.array(*[F.lit(p) for p in DERIVED_PHRASES]),
                            (k % len(DERIVED_PHRASES)).cast("int") + 1)
    amount = ((F.when(k % 211 == 0, F.lit(40)).otherwise(F.lit(1))
               * ((F.round(F.col("o_totalprice") * 0.05, 2) if fine else F.round(F.col("o_totalprice") / 1000) * 50) + 650.5))
              .cast("decimal(14,2)").cast("string"))
    fecha = F.when(k % 97 == 0, F.lit("not-a-date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    descripcion = (F.when(k % 101 == 0, F.lit(None).cast("string"))
                   .when(k % 103 == 0, F.concat(F.lit("  "), F.upper(merchant), F.lit("!! ")))
                   .otherwise(merchant))
    monto = (F.when(k % 89 == 0, F.lit("n/a"))
             .when(k % 83 == 0, F.lit("0"))
             .when(k % 79 == 0, F.concat(F.lit("-"), amount))
             .when(k % 73 == 0, F.concat(F.lit("$ "), amount))
             .when(k % 71 == 0, F.replace(amount, F.lit("."), F.lit(",")))
             .when(k % 67 == 0, F.lit("1,234.50"))
             .otherwise(amount))
    return o.select(k.alias("row_id"), fecha.alias("fecha"),
                    descripcion.alias("descripcion"), monto.alias("monto"))


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned transaction table (B1-B5 over ``expenses_raw``)."""
    from tallyspark.operators.clean import clean_expenses
    return clean_expenses(expenses_raw(spark, sf_dir))
