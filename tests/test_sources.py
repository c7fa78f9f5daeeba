"""A1-A11 and the streaming twin, with files in a per-test scratch folder."""

import csv
import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.schema import rename_plan, standardize_columns
from tallyspark.sources import files as Fs
from tallyspark.sources.records import ends_quoted
from tallyspark.sources.ingest import parse_quick_list, seed_training_set, synthesize
from tallyspark.sources.sinks import save_processed, save_report_json


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimited_separators(spark, scratch, sep):
    p = os.path.join(scratch, "g.csv")
    write(p, f"fecha{sep}descripcion{sep}monto\n2024-01-01{sep}Panadería{sep}10\n")
    df = Fs.load_data(spark, p)
    assert df.columns == ["fecha", "descripcion", "monto"]
    assert df.first()["descripcion"] == "Panadería"


def test_encodings_mixed(spark, scratch):
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    write(os.path.join(d, "a.csv"), "descripcion,monto\nBaño,1\n", "utf-8")
    write(os.path.join(d, "b.csv"), "descripcion,monto\nAño ñandú,2\n", "latin-1")
    got = sorted(r[0] for r in Fs.read_delimited(spark, d).select("descripcion").collect())
    assert got == ["Año ñandú", "Baño"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1", "utf-16-le", "utf-16-be", "utf-16"])
def test_quoted_breaks_in_any_encoding(spark, scratch, encoding):
    """Breaks, doubled quotes and separators in quotes, over files cut in many blocks, in their order."""
    rng, want = random.Random(encoding), []
    texts = ["plain", 'say "hi"; ok', "two\nlines", "a\r\nb\n\nc", "", '5" pipe', "ñandú" if encoding == "latin-1" else "ñandú €", "x" * 400]
    for k in range(2):
        rows = [[f"{k}-{i}", rng.choice(texts), str(i)] for i in range(40)]
        with open(os.path.join(scratch, f"f{k}.csv"), "w", encoding=encoding, newline="") as f:
            w = csv.writer(f, delimiter=";", lineterminator=["\n", "\r\n"][k], quoting=csv.QUOTE_ALL)
            w.writerows([["id, uno", "descripcion", "monto"], *rows])
        want += [(a, b or None, c) for a, b, c in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = Fs.read_delimited(spark, scratch, input_order=True)
        assert df.columns == ["id, uno", "descripcion", "monto", "row_id"]
        assert [tuple(r)[:3] for r in df.orderBy("row_id").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_that_open_nothing(spark, scratch):
    """A quote inside a field, and one that never closes."""
    write(os.path.join(scratch, "a.csv"), 'a,b\n5" pipe,1\n"x\ny",2\n6" pipe,3\n')
    write(os.path.join(scratch, "b.csv"), 'a,b\n"one\ntwo",1\n"never,2\nthree,3\nfour,4\n')
    got = [tuple(r) for r in Fs.read_delimited(spark, os.path.join(scratch, "a.csv")).collect()]
    assert sorted(got) == [('5" pipe', "1"), ('6" pipe', "3"), ("x\ny", "2")]
    got = {r[0]: r[1] for r in Fs.read_delimited(spark, os.path.join(scratch, "b.csv")).collect()}
    assert got["one\ntwo"] == "1" and got["three"] == "3" and got["four"] == "4" and len(got) == 4


def test_quotes_are_followed_over_small_parts(spark, scratch, monkeypatch):
    """Parts of four lines: fields longer than a part, parts without a record's start, a quote left open."""
    monkeypatch.setattr("tallyspark.sources.records.PART_BITS", 2)
    rng, want = random.Random(5), []
    for k in range(2):
        rows = [[f"{k}-{i}", rng.choice(["a", "b\n" * 3, "c\n\n" * 9 + "c", 'd "d"\n;d'])] for i in range(50)]
        with open(os.path.join(scratch, f"f{k}.csv"), "w", newline="") as f:
            csv.writer(f, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["id", "descripcion"], *rows])
        want += map(tuple, rows)
    with open(os.path.join(scratch, "f1.csv"), "a") as f:
        f.write('x;"open\n' + "".join(f"y{i};z\n" for i in range(9)))
    got = [tuple(r) for r in Fs.read_delimited(spark, scratch, input_order=True).orderBy("row_id").select("id", "descripcion").collect()]
    assert got[:100] == want
    assert [r[0] for r in got[100:]] == ["x", *[f"y{i}" for i in range(9)]]


def test_json_arrays_are_written_in_few_files(spark, scratch, monkeypatch):
    """Half the keys become arrays, in a file for each 50,000 keys, and all rows come back."""
    from tallyspark.plans import q_files as Q
    spark.range(120_000).select(F.col("id").alias("o_orderkey"), (F.col("id") + 0.5).alias("o_totalprice"), F.lit(dt.date(2024, 1, 1)).alias("o_orderdate")).write.parquet(os.path.join(scratch, "orders.parquet"))
    files = []
    monkeypatch.setattr(Q, "load_data", lambda s, p, keep=Q.load_data: files.append(sorted(x for x in os.listdir(p.removeprefix("file:")) if x.endswith(".txt"))) or keep(s, p))
    got = Q.a3_both(spark, scratch)
    assert len(files[0]) == 3
    assert got.count() == Q.expenses(spark, scratch).count()


def test_utf16_line_end_between_characters(spark, scratch):
    text = "a,b\nx\u0a05\u0a00\u000ay,1\n" + "".join(f"ਊ\u4e00\u0100{k},2\n" for k in range(5))
    for encoding in ("utf-16-le", "utf-16-be"):
        p = os.path.join(scratch, encoding + ".csv")
        write(p, text.replace("\u000ay", "y"), encoding)
        assert Fs.read_delimited(spark, p).count() == 6


def test_line_states_match_a_plain_walk(spark):
    """Where lines end, against a character by character walk."""
    def walk(line, sep, inside):
        state = 2 if inside else 1
        for c in line:
            if c == '"':
                state = {0: 0, 1: 2, 2: 3, 3: 2}[state]
            elif state != 2:
                state = 1 if c == sep else 0
        return state == 2

    rng = random.Random(8)
    lines = ["".join(rng.choice('a",";') for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = df.select("t", *[ends_quoted(F.col("t"), F.lit(s), i).alias(f"{s}{i}") for s in ",;" for i in (False, True)]).collect()
    assert all(list(r)[1:] == [walk(r.t, s, i) for s in ",;" for i in (False, True)] for r in got)


def test_json_and_dispatch(spark, scratch):
    p = os.path.join(scratch, "g.json")
    write(p, json.dumps([{"fecha": "2024-01-01", "descripcion": "Cine", "monto": 10.5}]))
    assert Fs.load_data(spark, p).first()["monto"] == "10.5"
    with pytest.raises(ValueError):
        Fs.load_data(spark, os.path.join(scratch, "x.xlsx"))
    with pytest.raises(ValueError):
        Fs.load_data(spark, os.path.join(scratch, "x.doc"))
    with pytest.raises(Exception):
        Fs.load_data(spark, os.path.join(scratch, "missing.csv")).count()


def test_inventory(spark, scratch):
    write(os.path.join(scratch, "a.csv"), "x\n1\n")
    write(os.path.join(scratch, "b.doc"), "x")
    inv = {r["name"]: r for r in Fs.file_inventory(spark, scratch).collect()}
    assert inv["a.csv"]["is_supported"] and not inv["b.doc"]["is_supported"]
    assert inv["a.csv"]["extension"] == ".csv" and inv["a.csv"]["size"] == 4


def test_standardize_headers(spark):
    assert rename_plan(["Fecha Valor", " IMPORTE ", "Merchant"]) == {
        "fecha valor": "monto", "merchant": "descripcion"}
    df = spark.createDataFrame([("x", "12", "abc")], "update_id string, total string, nota string")
    out = standardize_columns(df)
    assert out.first()["monto"] == "12"          # first numeric column
    assert out.first()["descripcion"] == "x"     # first text column
    df2 = spark.createDataFrame([("a", "b")], "Fecha string, Detalle string")
    assert "monto" not in standardize_columns(df2).columns


def test_quick_list(spark):
    text = "\n".join(["2024-01-15, Supermercado Carrefour, 18500", "Uber viaje, 2.800",
                      "- Netflix: $2.490", "Cena restaurant: 15000 pesos", "", "a: b: 1",
                      "Cena, 18,5", "solo texto"])
    df = spark.createDataFrame([(1, text)], "list_id bigint, texto string")
    rows = parse_quick_list(df, base_date=dt.date(2024, 2, 1)).orderBy("linea").collect()
    got = [(r["linea"], r["descripcion"], r["monto"]) for r in rows]
    assert got == [(1, "Supermercado Carrefour", 18500.0), (2, "Uber viaje", 2800.0),
                   (3, "Netflix", 2490.0), (4, "Cena restaurant", 15000.0)]
    assert rows[0]["fecha"] == dt.datetime(2024, 1, 15) and rows[1]["fecha"] == dt.datetime(2024, 2, 1)


def test_synthesize_is_deterministic(spark):
    ids = spark.range(500)
    a = synthesize(ids).collect()
    b = synthesize(ids.repartition(7)).collect()
    assert a == b
    assert all(r["fecha"] <= dt.datetime(2024, 6, 30) for r in a)
    assert [r["fecha"] for r in a] == sorted(r["fecha"] for r in a)
    assert seed_training_set(spark).groupBy("categoria").count().where("count = 10").count() == 8


def test_sinks(spark, scratch):
    df = spark.createDataFrame([(1, "a")], "id int, d string")
    out = save_processed(df, os.path.join(scratch, "out.xlsx"))
    assert out.endswith(".csv") and spark.read.option("header", True).csv(out).count() == 1
    rep = spark.createDataFrame([(1, {"a": 1})], "n int, m map<string,int>")
    p = save_report_json(rep, os.path.join(scratch, "rep.json"))
    assert spark.read.json(p).first()["n"] == 1


def test_streaming_landing(spark, scratch):
    from tallyspark.streaming.landing import landing_stream, start_append
    land = os.path.join(scratch, "landing")
    os.makedirs(land)
    write(os.path.join(land, "f1.csv"), "fecha,descripcion,monto\n2024-01-01,Cine Hoyts,3500\n"
                                        "2024-01-02,,10\n2024-01-03,Farmacia,-20\n")
    q = start_append(landing_stream(spark, land), os.path.join(scratch, "sink"),
                     os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = {r["descripcion"]: (r["categoria"], r["monto"])
           for r in spark.read.parquet(os.path.join(scratch, "sink")).collect()}
    assert got == {"cine hoyts": ("Entretenimiento", 3500.0), "farmacia": ("Salud", 20.0),
                   "nan": ("Otros", 10.0)}
