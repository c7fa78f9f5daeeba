"""E7, E12, B15, B21 and A6 edge cases from SURVEY §8."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import analytics as A
from tallyspark.operators.present import preset_totals
from tallyspark.operators.quality import narrowing_plan, typed_view, validate
from tallyspark.operators.schema import standardize_columns


def test_validate_messages_and_score(spark):
    raw = spark.createDataFrame([("2024-01-01", None, "10"), ("x", "a", "-5"), ("2024-01-01", None, "10"),
                                 ("2024-01-02", "b", "0"), ("2024-01-03", "c", "n/a")],
                                "fecha string, descripcion string, monto string")
    r = validate(typed_view(raw)).first()
    assert r["valid"] and r["row_count"] == 5
    assert (r["empty_descriptions"], r["invalid_amounts"], r["negative_amounts"], r["zero_amounts"],
            r["invalid_dates"], r["duplicate_rows"]) == (2, 1, 1, 1, 1, 1)
    assert r["data_quality_score"] == 100 - 6 * 5          # each kind of warning costs 5 once
    missing = validate(spark.createDataFrame([("x",)], "fecha string")).first()
    assert not missing["valid"] and missing["issues"] == ["Columnas faltantes: ['descripcion', 'monto']"]
    assert missing["data_quality_score"] == 80


def test_trend_without_earlier_spend(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10), 5.0), (dt.datetime(2024, 1, 20), 7.0), (None, 3.0)],
                               "fecha timestamp_ntz, monto double")
    r = A.trend(df).first()
    assert (r["recent_total"], r["previous_total"], r["trend_percentage"]) == (12.0, 0.0, 0.0)
    df2 = df.union(spark.createDataFrame([(dt.datetime(2023, 1, 1), 10.0)], df.schema))
    r2 = A.trend(df2).first()
    assert r2["previous_total"] == 10.0 and r2["trend_percentage"] == pytest.approx(20.0)


def test_presets(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 28), 1.0), (dt.datetime(2023, 12, 31), 2.0),
                                (dt.datetime(2023, 12, 31, 10), 4.0), (dt.datetime(2024, 1, 1), 8.0)],
                               "fecha timestamp_ntz, monto double")
    got = {r["preset"]: r["total"] for r in preset_totals(df, dt.datetime(2024, 6, 30, 12)).collect()}
    assert got["Última semana"] == 1.0
    assert got["Este año"] == 9.0
    assert got["Año pasado"] == 2.0           # the range ends at midnight of Dec 31


def test_narrowing_plan(spark):
    df = spark.createDataFrame([(1, 300, 1.5, 0.1, "a"), (2, 40000, 2.0, 0.2, "a"), (3, 5, 3.0, 0.3, "b")],
                               "a int, b bigint, c double, d double, e string")
    plan = {r["column"]: r["chosen_type"] for r in narrowing_plan(df).collect()}
    assert plan == {"a": "tinyint", "b": "int", "c": "float", "d": "double", "e": "string"}
    df2 = spark.range(10).select(F.lit("x").alias("t"))
    assert narrowing_plan(df2).first()["chosen_type"] == "category"


def test_standardize_duplicate_names(spark):
    df = spark.createDataFrame([("2024-01-01", "7", "cafe", "9")], "fecha_valor string, monto string, detalle string, x string")
    out = standardize_columns(df)
    # 'fecha_valor' contains 'valor': it becomes both fecha and then monto; the original 'monto' is left out
    assert out.columns.count("monto") == 1 and out.first()["monto"] == "2024-01-01"
    assert out.first()["descripcion"] == "cafe"


def test_dates_ignore_session_time_zone(spark):
    from tallyspark.functions.dates import parse_date
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 1),), (dt.datetime(2024, 3, 20, 23),)], "fecha timestamp_ntz")
        assert A.period(df).first()["dias_total"] == 19          # across the March DST change
        txt = spark.createDataFrame([("31/02/2024",), ("15/01/2024",), ("2024-03-10 02:30:00",)], "s string")
        assert [r[0] for r in txt.select(parse_date(F.col("s"))).collect()] == [
            None, dt.datetime(2024, 1, 15), dt.datetime(2024, 3, 10, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
