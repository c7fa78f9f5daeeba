"""Unit frames for every parsing/formatting rule."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions.dates import date_range_label, parse_date, period_name
from tallyspark.functions.money import clean_amount, format_amount, format_amount_short, parse_amount
from tallyspark.functions.text import clean_description, normalize_for_matching
from tallyspark.operators.clean import clean_expenses


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_clean_amount(spark):
    vals = ["$ 18,5", "1,234.50", "1.234,50", "-20", "0", "", "nan", "inf", "1.5d", "1e3", None]
    out = one_col(spark, vals, clean_amount)
    assert out[0] == 18.5
    assert out[1] is None and out[2] is None          # two dots after ',' -> '.'
    assert out[3] == 20.0                              # refunds count as spending
    assert out[4] == 0.0
    assert out[5] is None and out[6] is None           # '' and NaN -> NULL
    assert out[7] == float("inf")
    assert out[8] is None                              # '1.5d' is not a number
    assert out[9] == 1000.0
    assert out[10] is None


def test_parse_amount(spark):
    out = one_col(spark, ["$1,234.50", "abc", None, " 12 "], parse_amount)
    assert out == [1234.5, 0.0, 0.0, 12.0]


def test_parse_date(spark):
    out = one_col(spark, ["2024-01-05", "2024-1-5", "15/01/2024", "2024", "x", None], parse_date)
    assert out[0] == dt.datetime(2024, 1, 5)
    assert out[1] == dt.datetime(2024, 1, 5)
    assert out[2] == dt.datetime(2024, 1, 15)
    assert out[3] is None and out[4] is None and out[5] is None


def test_clean_description(spark):
    out = one_col(spark, ["  Baño: H&M!! ", "Dr. Gómez", None, "a\tb"], clean_description)
    assert out[0] == "baño h m "    # trim happens before punctuation removal
    assert out[1] == "dr gómez"
    assert out[2] == "nan"
    assert out[3] == "a b"


def test_normalize(spark):
    out = one_col(spark, ["La Anonima de Palermo", None, "Bar y Pub"], normalize_for_matching)
    assert out == ["anonima palermo", "", "bar pub"]


def test_format_money(spark):
    out = one_col(spark, [1234.565, None, 0.125, -5.0], lambda c: format_amount(c), "double")
    assert out[0] == "$1,234.57" and out[1] == "$0.00" and out[3] == "$-5.00"
    short = one_col(spark, [1_500_000.0, 2800.0, 650.0, None, -5000.0, 2.5], format_amount_short, "double")
    assert short == ["$1.5M", "$2.8K", "$650", "$0", "$-5000", "$2"]


def test_period_and_range_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)),
                                (dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 1)),
                                (dt.datetime(2023, 12, 5), dt.datetime(2024, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    rows = df.select(period_name(F.col("a")).alias("p"), date_range_label(F.col("a"), F.col("b")).alias("l")).collect()
    assert rows[0]["p"] == "Jan 2024"
    assert [r["l"] for r in rows] == ["5-20 January 2024", "January - March 2024",
                                      "December 2023 - January 2024"]


def test_clean_pipeline_dedupe_first_wins(spark):
    raw = spark.createDataFrame([
        (1, "2024-01-01", "Netflix", "2490"), (2, "2024-02-01", "netflix ", "2490"),
        (3, "2024-03-01", "Netflix", "2,490"), (4, "x", "Cine", "0"), (5, None, None, "10"),
        (6, "2024-01-02", "Cine", "n/a")], "row_id bigint, fecha string, descripcion string, monto string")
    out = {r["row_id"]: r for r in clean_expenses(raw).collect()}
    assert set(out) == {1, 3, 5}             # 'netflix ' strips to row 1's key -> duplicate
    assert out[5]["descripcion"] == "nan"     # missing description survives as text
    assert out[3]["monto"] == 2.49


def test_derived_view_counts(spark):
    from tallyspark.sources.tables import expenses
    e = expenses(spark, "/root/testdata/sf0.01")
    row = e.agg(F.count("*"), F.countDistinct("descripcion"), F.count("fecha"), F.round(F.sum("monto"), 2)).first()
    assert tuple(row) == (8617, 49, 8523, 153710873.5)
