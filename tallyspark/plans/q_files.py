"""Registered round-trip queries for the file sources and sinks.

Each writes data Spark derives from ``orders`` into a fresh folder under
the shared checkpoint directory, reads it back through the library's
readers and cleans it; the result must equal the cleaned view, so the
B5 SQL twin is the oracle.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tallyspark.operators.clean import clean_expenses
from tallyspark.operators.schema import standardize_columns
from tallyspark.operators.report import build_report
from tallyspark.plans.oracle import BASE, with_
from tallyspark.plans.q_anomaly import FLAGS
from tallyspark.plans.q_jobs import AS_OF, FLAT_SQL, flat_report
from tallyspark.plans.registry import register
from tallyspark.plans.views import expenses, expenses_raw, flagged_once
from tallyspark.session import ensure_checkpoint_dir, materialize
from tallyspark.sources.files import load_data
from tallyspark.sources.records import C1_CHARS, C1_CODES, MARK
from tallyspark.sources.sinks import save_processed, save_report_json

CLEAN_SQL = with_(*BASE) + "select * from expenses"


def scratch(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "roundtrip", f"{name}-{uuid.uuid4().hex}")


def drop_folder(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clean_back(df):
    """Typed key back (files hold text), then the usual cleaning."""
    df = standardize_columns(df).withColumn("row_id", F.col("row_id").cast("bigint"))
    return clean_expenses(df).select("row_id", "fecha", "descripcion", "monto")


def _kept(spark, df, path):
    """The result written once, and the files it came from removed."""
    out = materialize(df)
    drop_folder(spark, path)
    return out


@register("a1_csv_semicolon_roundtrip", CLEAN_SQL)
def a1(spark, sf):
    path = scratch(spark, "a1") + ".csv"
    expenses_raw(spark, sf).write.option("header", True).option("sep", ";").csv(path)
    return _kept(spark, _clean_back(load_data(spark, path)), path)  # separator found in the header


@register("a1_mixed_separators_roundtrip", CLEAN_SQL)
def a1_mixed(spark, sf):
    """One folder, five separators (the last one is none of the usual four), two encodings."""
    path = scratch(spark, "a1m") + ".csv"
    raw = expenses_raw(spark, sf)
    for k, sep in enumerate([",", ";", "\t", "|", "^"]):
        raw.where(F.col("row_id") % 5 == k).write.mode("append").option("header", True).option("sep", sep) \
           .option("encoding", "ISO-8859-1" if k % 2 else "UTF-8").csv(path)
    return _kept(spark, _clean_back(load_data(spark, path)), path)


@register("a2_mixed_encoding_roundtrip", CLEAN_SQL)
def a2(spark, sf):
    path = scratch(spark, "a2") + ".csv"
    raw = expenses_raw(spark, sf)
    # every row is written, half of them Latin-1 encoded
    raw.where(F.col("row_id") % 2 == 0).write.option("header", True).option("encoding", "UTF-8").csv(path)
    raw.where(F.col("row_id") % 2 == 1).write.mode("append").option("header", True) \
       .option("encoding", "ISO-8859-1").csv(path)
    return _kept(spark, _clean_back(load_data(spark, path)), path)


BROKEN = "case when row_id % 3 = 0 then replace(descripcion, ' ', {nl}) when row_id % 3 = 1 then '\"' || descripcion || '\"; \"\"' else descripcion end"


@register("a1_quoted_breaks_roundtrip", with_(BASE[0]) + f"""
select row_id, fecha, {BROKEN.format(nl="chr(13) || chr(10)")} as descripcion, monto from expenses_raw""")
def a1_breaks(spark, sf):
    """Line breaks, separators and doubled quotes inside quotes, and a comma in a quoted header of a ; file."""
    path = scratch(spark, "a1q") + ".csv"
    rows = expenses_raw(spark, sf).withColumn("descripcion", F.expr(BROKEN.format(nl="'\\r\\n'"))).withColumnRenamed("row_id", "fila, clave")
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = load_data(spark, path)
    return _kept(spark, back.select(F.col("fila, clave").cast("bigint").alias("row_id"), "fecha", "descripcion", "monto"), path)


ENCODED = "descripcion || case when row_id % 6 = 5 then ' año 5 € “sí”' else ' año 5' end"


@register("a2_five_encodings_roundtrip", with_(BASE[0]) + f"""
select row_id, fecha, {ENCODED} as descripcion, monto from expenses_raw""")
def a2_five(spark, sf):
    """UTF-8 with and without a mark, UTF-16 of both byte orders, ISO-8859-1 and Windows-1252 in one folder."""
    path = scratch(spark, "a2f") + ".csv"
    rows = expenses_raw(spark, sf).withColumn("descripcion", F.expr(ENCODED))
    for k, encoding in enumerate(["UTF-8", "UTF-8", "UTF-16LE", "UTF-16BE", "ISO-8859-1", "ISO-8859-1"]):
        part = rows.where(F.col("row_id") % 6 == k)
        if k == 1:
            part = part.withColumnRenamed("row_id", MARK + "row_id")
        if k == 5:  # Windows-1252 has these characters in place of ISO-8859-1's control codes
            part = part.withColumn("descripcion", F.translate("descripcion", C1_CHARS, C1_CODES))
        part.write.mode("append").option("header", True).option("encoding", encoding) \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = load_data(spark, path)
    return _kept(spark, back.select(F.col("row_id").cast("bigint").alias("row_id"), "fecha", "descripcion", "monto"), path)


@register("a3_json_roundtrip", CLEAN_SQL)
def a3(spark, sf):
    """JSON lines, told apart from documents by their first line."""
    path = scratch(spark, "a3") + ".json"
    expenses_raw(spark, sf).write.json(path)
    return _kept(spark, _clean_back(load_data(spark, path)), path)


ARRAY_KEYS = 50_000  # about 3 MB a file; each file costs a listing and an opening in every pass


@register("a3_json_both_forms_roundtrip", CLEAN_SQL)
def a3_both(spark, sf):
    """JSON lines and JSON arrays (one per file) in one folder."""
    path = scratch(spark, "a3b") + ".json"
    raw = expenses_raw(spark, sf)
    raw.where(F.col("row_id") % 2 == 0).write.json(path)
    rows = raw.where(F.col("row_id") % 2 == 1).withColumn("_part", F.floor(F.col("row_id") / ARRAY_KEYS))
    arrays = rows.groupBy("_part").agg(F.array_join(F.collect_list(F.to_json(F.struct(*raw.columns))), ",\n").alias("value"))
    # one array per file, ARRAY_KEYS keys each, written as their own files
    arrays.select(F.concat(F.lit("[\n"), "value", F.lit("\n]")).alias("value")).write \
          .option("maxRecordsPerFile", 1).mode("append").text(path)
    return _kept(spark, _clean_back(load_data(spark, path)), path)


@register("b5_first_wins_across_files", with_(*BASE[:2]) + """
, k as (select *, case when row_id % 10 = 0 then 0 when row_id % 10 <= 7 then 1 else 2 end as parte from typed),
f as (
  select row_id as clave, fecha, descripcion, monto, 'T' || parte as tipo,
    row_number() over (partition by descripcion, monto order by parte, row_id) as rn
  from k where monto is not null and not isnan(monto) and monto > 0 and length(descripcion) > 0)
select clave, fecha, descripcion, monto, tipo from f where rn = 1""")
def b5_files(spark, sf):
    """Files of unequal size with a text column: the first row in path and line order wins."""
    path = scratch(spark, "b5") + ".csv"
    raw = expenses_raw(spark, sf)
    k = F.col("row_id") % 10
    parts = [k == 0, (k > 0) & (k <= 7), k > 7]
    for n, part in enumerate(parts):
        rows = raw.where(part).repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
        rows.select(F.col("row_id").alias("clave"), "fecha", "descripcion", "monto", F.lit(f"T{n}").alias("tipo")) \
            .write.option("header", True).csv(f"{path}/parte={n}")
    back = clean_expenses(load_data(spark, path, input_order=True).drop("parte"))
    return _kept(spark, back.select(F.col("clave").cast("bigint").alias("clave"), "fecha", "descripcion", "monto", "tipo"), path)


@register("a7_save_processed_roundtrip", CLEAN_SQL)
def a7(spark, sf):
    path = save_processed(expenses(spark, sf), scratch(spark, "a7") + ".parquet")
    return _kept(spark, spark.read.parquet(path).select("row_id", "fecha", "descripcion", "monto"), path)


@register("a7_save_csv_roundtrip", CLEAN_SQL)
def a7_csv(spark, sf):
    path = save_processed(expenses(spark, sf), scratch(spark, "a7c") + ".xlsx")  # unknown suffix -> .csv
    back = (spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))
    back = back.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("fecha").cast("timestamp_ntz").alias("fecha"),
                       "descripcion", F.col("monto").cast("double").alias("monto"))
    return _kept(spark, back, path)


@register("a8_report_json_roundtrip", FLAGS + FLAT_SQL)
def a8(spark, sf):
    """The nested report written as JSON and read back, flat."""
    report = build_report(flagged_once(spark, sf), as_of=AS_OF)
    path = save_report_json(report, scratch(spark, "a8"))
    return _kept(spark, flat_report(spark.read.json(path)), path)


@register("d14_model_save_load")
def d14(spark, sf):
    from tallyspark.ml import categorizer as M
    df = expenses(spark, sf)
    res = M.train(df, cfg=M.BASE)
    path = scratch(spark, "d14")
    M.save_model(res, path)
    out = M.predict_with_confidence(M.load_model(path), df, "ml")
    return _kept(spark, out.select("row_id", "categoria", F.round("confidence", 6).alias("confidence"), "method"), path)


@register("d14_same_after_load", with_(*BASE) + "select count(*) as filas, 0::bigint as distintas from expenses")
def d14_same(spark, sf):
    """Predictions of the model in memory and of the one read back."""
    from tallyspark.ml import categorizer as M
    df = materialize(expenses(spark, sf))
    res = M.train(df, cfg=M.IMPROVED)
    path = scratch(spark, "d14s")
    M.save_model(res, path)
    one = M.predict_with_confidence(res.model, df).select("row_id", "categoria", "confidence")
    two = M.predict_with_confidence(M.load_model(path), df).select("row_id", F.col("categoria").alias("c2"), F.col("confidence").alias("f2"))
    same = (F.col("categoria") == F.col("c2")) & (F.abs(F.col("confidence") - F.col("f2")) < 1e-9)
    return _kept(spark, one.join(two, "row_id", "full").agg(F.count(F.lit(1)).alias("filas"), F.count_if(~F.coalesce(same, F.lit(False))).alias("distintas")), path)
