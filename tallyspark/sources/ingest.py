"""Row ingest: append (A9), free-text lists (A10), generator (A11), seed set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.constants import MERCHANT_CATALOGUE
from tallyspark.functions.dates import parse_date, ts_lit
from tallyspark.functions.money import _to_double
from tallyspark.functions.text import strip


def append_transactions(base: DataFrame, new: DataFrame) -> DataFrame:
    """Add entries with a non-empty description and a positive amount."""
    ok = new.where(F.col("descripcion").isNotNull() & (F.length(strip(F.col("descripcion"))) > 0)
                   & F.col("monto").isNotNull() & (F.col("monto") > 0))
    return base.unionByName(ok, allowMissingColumns=True)


def parse_quick_list(df: DataFrame, text_col: str = "texto", base_date: dt.date | None = None,
                     id_col: str = "list_id") -> DataFrame:
    """A10: one transaction per line, three layouts tried in order.

    Per line: strip, skip blanks, delete ``$``, every ``.`` and ``pesos``.
    (1) >= 2 commas: date, text, number; (2) exactly 1 comma: text, number
    (base date); (3) a ``:`` splitting the line in exactly 2 parts: text
    without ``-``, all digit runs of the rest joined (base date).  Lines no
    layout parses are dropped.  ``posexplode`` keeps the line position.
    """
    base = ts_lit(base_date or dt.date.today())
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
    line = strip(F.col("raw"))
    c = strip(F.replace(F.replace(F.replace(line, F.lit("$"), F.lit("")), F.lit("."), F.lit("")),
                        F.lit("pesos"), F.lit("")))
    parts = F.transform(F.split(c, ","), lambda p: strip(p))
    n_commas = F.size(F.split(c, ",")) - 1
    # layout 1
    f1_date = parse_date(parts[0])
    f1_amount = _to_double(parts[2])
    ok1 = (n_commas >= 2) & f1_date.isNotNull() & f1_amount.isNotNull()
    # layout 2
    f2_amount = _to_double(parts[1])
    ok2 = (n_commas == 1) & f2_amount.isNotNull()
    # layout 3
    colon = F.split(c, ":")
    digits = F.array_join(F.regexp_extract_all(colon[1], F.lit(r"[0-9]+"), 0), "")
    ok3 = c.contains(":") & (F.size(colon) == 2) & (F.length(digits) > 0)
    f3_desc = strip(F.replace(colon[0], F.lit("-"), F.lit("")))

    def pick(a: Column, b: Column, d: Column) -> Column:
        return F.when(ok1, a).when(ok2, b).when(ok3, d)
    return (lines.where(line != "")
                 .select(id_col, (F.col("pos") + 1).alias("linea"),
                         pick(f1_date, base, base).alias("fecha"),
                         pick(parts[1], parts[0], f3_desc).alias("descripcion"),
                         pick(f1_amount, f2_amount, digits.cast("double")).alias("monto"))
                 .where(F.col("monto").isNotNull()))


def lcg(x: Column) -> Column:
    """One step of a 31-bit linear congruential generator (bigint-safe)."""
    return ((x % 2147483648) * 1103515245 + 12345) % 2147483648


def synthesize(ids: DataFrame, id_col: str = "id", as_of: dt.date = dt.date(2024, 6, 30),
               period_days: int = 90) -> DataFrame:
    """One synthetic transaction per input id.

    Merchant, amount (uniform in the merchant's range), date (in the last
    ``period_days`` before ``as_of``) and confidence come from an LCG on
    the id, so the result depends only on the ids -- not on partitioning
    -- and an SQL engine can repeat it.  Sorted by date (range-partitioned
    global sort).
    """
    names = F.array(*[F.lit(m) for m, _, _ in MERCHANT_CATALOGUE])
    cats = F.array(*[F.lit(c) for _, c, _ in MERCHANT_CATALOGUE])
    lows = F.array(*[F.lit(float(r[0])) for _, _, r in MERCHANT_CATALOGUE])
    highs = F.array(*[F.lit(float(r[1])) for _, _, r in MERCHANT_CATALOGUE])
    x1 = lcg(F.col(id_col))
    x2 = lcg(x1)
    x3 = lcg(x2)
    idx = (F.floor(x1 / 65536) % len(MERCHANT_CATALOGUE)).cast("int") + 1
    u = x2 / F.lit(2147483648.0)
    start = ts_lit(as_of - dt.timedelta(days=period_days))
    days = (x3 % (period_days + 1)).cast("int")
    conf = 0.85 + 0.13 * (F.floor(x3 / 65536) % 10000) / 10000.0
    out = ids.select(
        F.col(id_col).alias("id"),
        (start + F.make_dt_interval(days)).alias("fecha"),
        F.element_at(names, idx).alias("descripcion"),
        F.round(F.element_at(lows, idx) + (F.element_at(highs, idx) - F.element_at(lows, idx)) * u, 2)
         .alias("monto"),
        F.element_at(cats, idx).alias("categoria_ia"),
        F.round(conf, 6).alias("confianza_ia"))
    return out.orderBy("fecha", "id")


# Our own labelled seed phrases (A12): 10 per weighted category.
SEED_PHRASES: list[tuple[str, str]] = [
    ("supermercado compra del mes", "Alimentación"), ("pizza con amigos viernes", "Alimentación"),
    ("panaderia medialunas", "Alimentación"), ("verduleria tomates y papas", "Alimentación"),
    ("almacen de barrio yerba", "Alimentación"), ("carniceria asado domingo", "Alimentación"),
    ("cafe con leche y tostado", "Alimentación"), ("heladeria cuarto kilo", "Alimentación"),
    ("restaurant menu ejecutivo", "Alimentación"), ("comida rapida burger", "Alimentación"),
    ("uber a la oficina", "Transporte"), ("taxi nocturno", "Transporte"),
    ("nafta tanque lleno", "Transporte"), ("peaje ruta costera", "Transporte"),
    ("subte ida y vuelta", "Transporte"), ("estacionamiento centro", "Transporte"),
    ("cochera del edificio", "Transporte"), ("pasaje de tren", "Transporte"),
    ("carga sube semanal", "Transporte"), ("remis al aeropuerto", "Transporte"),
    ("factura de luz electricidad", "Servicios"), ("internet hogar mensual", "Servicios"),
    ("telefono fijo abono", "Servicios"), ("gas de red bimestral", "Servicios"),
    ("agua corriente", "Servicios"), ("expensas ordinarias", "Servicios"),
    ("cable y tv", "Servicios"), ("celular abono plan", "Servicios"),
    ("wifi portatil", "Servicios"), ("servicio de mantenimiento", "Servicios"),
    ("netflix plan estandar", "Entretenimiento"), ("cine estreno sabado", "Entretenimiento"),
    ("spotify familiar", "Entretenimiento"), ("teatro obra clasica", "Entretenimiento"),
    ("juego para consola", "Entretenimiento"), ("recital al aire libre", "Entretenimiento"),
    ("boliche entrada general", "Entretenimiento"), ("concierto de jazz", "Entretenimiento"),
    ("pub cerveza artesanal", "Entretenimiento"), ("pelicula en streaming", "Entretenimiento"),
    ("farmacia ibuprofeno", "Salud"), ("consulta medico clinico", "Salud"),
    ("dentista arreglo muela", "Salud"), ("laboratorio analisis de rutina", "Salud"),
    ("clinica guardia", "Salud"), ("kinesiologo rodilla", "Salud"),
    ("oculista control anual", "Salud"), ("psicologo sesion semanal", "Salud"),
    ("pediatra control", "Salud"), ("medicamento recetado", "Salud"),
    ("remera de algodon", "Ropa"), ("zapatillas para correr", "Ropa"),
    ("jean azul oscuro", "Ropa"), ("campera de abrigo", "Ropa"),
    ("vestido de fiesta", "Ropa"), ("zapatos de cuero", "Ropa"),
    ("medias deportivas", "Ropa"), ("buzo con capucha", "Ropa"),
    ("camisa formal", "Ropa"), ("pantalon de vestir", "Ropa"),
    ("ferreteria tornillos y tarugos", "Hogar"), ("muebles para el living", "Hogar"),
    ("detergente y lavandina", "Hogar"), ("pintura latex blanca", "Hogar"),
    ("bazar vasos y platos", "Hogar"), ("lampara de escritorio", "Hogar"),
    ("herramientas de jardin", "Hogar"), ("electrodomestico licuadora", "Hogar"),
    ("decoracion cortinas", "Hogar"), ("limpieza productos", "Hogar"),
    ("universidad matricula anual", "Educación"), ("curso de fotografia", "Educación"),
    ("libro de texto", "Educación"), ("instituto de ingles", "Educación"),
    ("academia de musica", "Educación"), ("escuela cuota mensual", "Educación"),
    ("colegio materiales", "Educación"), ("capacitacion online", "Educación"),
    ("maestria en datos", "Educación"), ("estudio de idiomas", "Educación"),
]


def seed_training_set(spark: SparkSession) -> DataFrame:
    """The labelled seed set (descripcion, categoria)."""
    return spark.createDataFrame(SEED_PHRASES, "descripcion string, categoria string")
