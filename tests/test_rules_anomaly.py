"""C1-C7, F1-F5, E-operators on small frames and on the reference's own example."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import analytics as A
from tallyspark.operators import anomaly as N
from tallyspark.operators.clean import clean_expenses
from tallyspark.operators.reuse import cache_stats
from tallyspark.operators.rules import (categorize_first_match, categorize_weighted, category_distribution,
                                        pseudo_labels)

# Description and amount of the published example, one row a day.
GOLDEN = [
    ("Supermercado Carrefour Villa Crespo", 18500.5),
    ("Panaderia La Esquina", 3200.0),
    ("McDonalds Palermo", 4800.75),
    ("Restaurant Don Julio", 25000.0),
    ("Verduleria Central", 5500.3),
    ("Uber viaje centro", 2800.0),
    ("YPF Combustible", 15000.0),
    ("SUBE recarga", 2000.0),
    ("Taxi Aeropuerto", 8500.0),
    ("Peaje Autopista", 650.0),
    ("Edenor Factura Electricidad", 12000.0),
    ("Movistar Plan Celular", 8900.0),
    ("Fibertel Internet", 6500.0),
    ("Metrogas Factura", 15000.0),
    ("Expensas Edificio", 45000.0),
    ("Netflix Suscripcion", 2490.0),
    ("Cine Hoyts Palermo", 3500.0),
    ("Spotify Premium", 1290.0),
    ("Bar Antares Cerveza", 8500.0),
    ("Steam Videojuego", 12000.0),
    ("Farmacity Medicamentos", 4500.0),
    ("Dr. Martinez Consulta", 15000.0),
    ("Dentista Limpieza", 18000.0),
    ("Laboratorio Analisis", 8500.0),
    ("Farmacia del Pueblo", 2800.0),
    ("Zara Camisa Trabajo", 12500.0),
    ("Nike Zapatillas Running", 35000.0),
    ("H&M Pantalon Jean", 8900.0),
    ("Adidas Campera", 28000.0),
    ("Easy Herramientas", 5500.0),
    ("Sodimac Pintura", 8900.0),
    ("Detergente Skip", 1200.0),
    ("IKEA Escritorio", 45000.0),
    ("Universidad UTN Cuota", 25000.0),
    ("Udemy Curso Python", 15000.0),
    ("Libros Amazon", 8500.0),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, descripcion string, monto double")


def test_weighted_ties_and_traps(spark):
    df = frame(spark, [(1, "bar y pub amigos", 1.0), (2, "zapatillas y medias", 1.0),
                       (3, "h m remera", 1.0), (4, "la anonima", 1.0), (5, "transferencia varios", 1.0),
                       (6, "consulta dr gomez", 1.0), (7, "gasolina", 1.0)])
    out = {r["row_id"]: r for r in categorize_weighted(df).collect()}
    # bar: Alimentación 2.0 vs bar+pub Entretenimiento 3.0
    assert out[1]["categoria"] == "Entretenimiento" and out[1]["confidence"] == pytest.approx(0.6)
    assert out[2]["categoria"] == "Ropa"           # dia (2.0, via 'medias') < zapatillas+medias (3.4)
    assert out[3]["categoria"] == "Ropa"           # remera
    assert out[4]["categoria"] == "Otros" and out[4]["confidence"] == pytest.approx(0.1)
    assert out[5]["categoria"] == "Transporte"     # 'transfer' is a substring
    assert out[6]["categoria"] == "Salud" and out[6]["confidence"] == pytest.approx(0.88)
    assert out[7]["categoria"] == "Transporte"     # gasolina (2.0) beats gas (1.8)


def test_first_match_order(spark):
    df = frame(spark, [(1, "zapatillas y medias", 1.0), (2, "la anonima", 1.0), (3, "h m remera", 1.0)])
    out = {r["row_id"]: r["categoria"] for r in categorize_first_match(df).collect()}
    assert out == {1: "Alimentación", 2: "Alimentación", 3: "Otros"}


def test_distinct_scoring_equals_per_row(spark):
    from tallyspark.operators.reuse import categorize_distinct
    e = frame(spark, [(i, d, 1.0) for i, d in enumerate(["cine", "bar", " CINE ", "libro", "x", "cine y bar", None])])
    cols = ["row_id", "categoria", "confidence"]
    a = sorted(tuple(r) for r in categorize_distinct(e).select(cols).collect())
    b = sorted(tuple(r) for r in categorize_weighted(e).select(cols).collect())
    assert a == b and a[5][1] == "Entretenimiento"


def test_pseudo_labels_and_distribution(spark):
    df = frame(spark, [(1, "cine", 1.0), (2, "nada", 1.0), (3, "cine", 2.0)])
    assert pseudo_labels(df).count() == 2
    dist = {r["categoria"]: (r["count"], r["percentage"]) for r in category_distribution(df).collect()}
    assert dist["Entretenimiento"][0] == 2 and dist["Otros"][1] == pytest.approx(100 / 3)


def test_cache_stats(spark):
    df = frame(spark, [(1, "Cine ", 1.0), (2, "cine", 1.0), (3, "bar", 1.0), (4, "CINE", 1.0)])
    r = cache_stats(df).first()
    assert (r["total_predictions"], r["cache_size"], r["cache_hits"]) == (4, 2, 2)
    assert r["hit_rate"] == pytest.approx(0.5)


def test_anomaly_edges(spark):
    one = frame(spark, [(1, "a", 5.0)])
    assert N.zscore_global(one).first()["is_anomaly"] is False
    flat = frame(spark, [(i, "a", 5.0) for i in range(12)])
    assert N.zscore_global(flat).where("is_anomaly").count() == 0
    small = frame(spark, [(i, "a", float(i)) for i in range(9)])
    out = N.detect_anomalies(small.withColumn("categoria", F.lit("x")), use_isolation_forest=False)
    assert out.where("is_any_anomaly").count() == 0 and "is_category_anomaly" in out.columns
    # category of size 3 never flags; of size 4+ can
    rows = [(i, "a", 10.0) for i in range(3)] + [(10 + i, "b", 10.0) for i in range(30)] + [(99, "b", 1000.0)]
    df = frame(spark, rows).withColumn("categoria", F.col("descripcion"))
    flags = {r["row_id"]: r["is_category_anomaly"] for r in N.zscore_by_category(df).collect()}
    assert flags[99] is True and not any(flags[i] for i in range(3))


def test_exact_median_selection(spark):
    from tallyspark.operators.stats import exact_median, exact_quantile
    df = spark.range(10001).select((F.col("id") * 7 % 10001).cast("double").alias("v"))
    assert exact_median(df, "v") == 5000.0
    even = spark.range(10).select(F.col("id").cast("double").alias("v"))
    assert exact_median(even, "v") == 4.5
    assert exact_quantile(even, "v", 0.9) == pytest.approx(8.1)
    skew = spark.range(3000).select(F.when(F.col("id") < 1000, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert exact_median(skew, "v") == skew.agg(F.median("v")).first()[0]


def test_published_example_golden(spark):
    """The published 36-row example: totals, z-scores and categories from SURVEY §5."""
    days = [d for d in (dt.date(2024, 1, 15) + dt.timedelta(days=k) for k in range(37)) if d != dt.date(2024, 1, 31)]
    raw = spark.createDataFrame([(k, str(d), text, str(x)) for k, (d, (text, x)) in enumerate(zip(days, GOLDEN, strict=True))],
                                "row_id bigint, fecha string, descripcion string, monto string")
    e = clean_expenses(raw).cache()
    assert e.count() == 36
    assert round(e.agg(F.sum("monto")).first()[0], 2) == 443431.55
    assert A.overall(e).first()["monto_mediano"] == 8700.0
    z = N.zscore_global(e)
    anomalies = z.where("is_anomaly").select("monto").collect()
    assert sorted(r[0] for r in anomalies) == [45000.0, 45000.0]
    assert z.agg(F.max("z_score")).first()[0] == pytest.approx(2.856380344779029)
    counts = {r["categoria"]: r["count"] for r in categorize_weighted(e).groupBy("categoria").count().collect()}
    assert counts == {"Alimentación": 6, "Transporte": 5, "Servicios": 5, "Salud": 5,
                      "Entretenimiento": 4, "Ropa": 4, "Hogar": 4, "Educación": 3}


def test_exact_median_extremes(spark):
    from tallyspark.operators.stats import exact_median
    vals = [float("-inf"), -1e308, 1.0, 2.0, 3.0, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert exact_median(df, "v") == 2.0
    df2 = spark.createDataFrame([(v,) for v in [float("inf")] * 3 + [1.0]], "v double")
    assert exact_median(df2, "v") == float("inf")


def test_quantiles_match_sorted_values(spark):
    import random

    from tallyspark.operators.stats import exact_quantile
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 2000):
        vals = [rng.choice([rng.gauss(0, 1), 7.0, 1e-300, -1e300, rng.randrange(5)]) for _ in range(n)]
        df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "v double")
        for q in (0.0, 0.3, 0.5, 0.97, 1.0):
            at, s = q * (n - 1), sorted(float(v) for v in vals)
            lo, hi = s[int(at)], s[min(int(at) + 1, n - 1)]
            assert exact_quantile(df, "v", q) == pytest.approx(lo + (hi - lo) * (at - int(at)))


def test_missing_category_is_a_group(spark):
    from tallyspark.operators.report import build_report
    rows = [(i, "a", float(i)) for i in range(20)]
    df = frame(spark, rows).withColumn("categoria", F.when(F.col("row_id") >= 10, F.lit("x")))
    ins = A.category_insights(df).collect()
    assert sorted((r["categoria"] or "", r["top_rank"]) for r in ins) == [("", 1), ("", 2), ("", 3), ("x", 1), ("x", 2), ("x", 3)]
    assert sum(r["transaction_count"] for r in ins if r["top_rank"] == 1) == 20
    flags = N.zscore_by_category(df)
    assert flags.count() == 20
    rep = build_report(df.withColumn("confidence", F.lit(0.5)).withColumn("method", F.lit("m")).withColumn("fecha", F.lit(None).cast("timestamp_ntz"))).first()
    assert set(rep["categorias_detalladas"]) == {"x", "Sin categorizar"}
