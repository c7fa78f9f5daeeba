"""File sources (A1-A5).

Everything is read as strings (no inference pass over the data); typing
happens in the cleaning transforms.  What a file is (separator, encoding, quoted
line breaks, JSON array or lines) is found per file by one Spark aggregation
over its lines; only the distinct forms reach the driver.  Files that Spark's
CSV reader can't split (quoted line breaks) or decode line by line go through
``records``.  A folder of one form is
read as a whole.  Where forms are mixed, each form's files are read by
their names, which Spark's file listing holds on the driver anyway.

On request rows get their true input order (file path, place in the file)
as ``row_id``, unless the files bring a column of that name.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.order import place, with_input_order
from tallyspark.session import materialize
from tallyspark.sources.records import LINE_ENDS, MARK, decoded, opens, read_records

SEPARATORS = [",", ";", "\t", "|"]
ALL_SEPARATORS = [*SEPARATORS, ":", "^", "~", "#", "*"]
ENCODINGS = ["UTF-8", "ISO-8859-1", "WINDOWS-1252", "UTF-16LE", "UTF-16BE"]
SUPPORTED = [".csv", ".xlsx", ".xls", ".json", ".txt"]
READABLE = [".csv", ".txt", ".json", ".parquet"]


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """Per file: its first line that is not blank, whether all its bytes are UTF-8, whether it has
    bytes 0x80-0x9F in lines that are not, and whether a line opens a quote that it doesn't close.

    The text source keeps each line's raw bytes.  A line's place is its
    block's start and its position in the scan; a partial aggregation
    keeps one line per file and task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    text = F.trim("value")
    # a file that is nothing but blank lines still has a row
    seen = F.when(F.length(text) > 0, F.struct("block", "id", F.col("value").alias("line")))
    valid = F.expr("is_valid_utf8(value)")
    high = F.when(~valid, F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike("[\u0080-\u009f]"))
    per_block = lines.groupBy("file", "block").agg(F.min(seen).alias("one"), F.min(valid).alias("utf8"), F.max(high).alias("high"), F.max(opens(F.col("value"), ALL_SEPARATORS)).alias("broken"))
    return per_block.groupBy("file").agg(F.min("one").alias("one"), F.min("utf8").alias("utf8"), F.max("high").alias("high"), F.max("broken").alias("broken")) \
                    .select("file", F.coalesce("one.line", F.lit("")).alias("header"), "utf8", F.coalesce("high", F.lit(False)).alias("high"), "broken")


def encoding_of(header: Column, utf8: Column, high: Column) -> Column:
    """A2 from a file's bytes: a mark at its start, zero bytes in odd or even places of its first
    line, invalid UTF-8, and bytes that are control codes in ISO-8859-1 but letters and marks in
    Windows-1252."""
    bytes_ = F.hex(header.cast("binary"))
    pairs = F.regexp_extract_all(bytes_, F.lit("(....)"), F.lit(1))
    zeros = lambda side: F.size(F.filter(pairs, side))
    low, up = zeros(lambda p: p.endswith("00")), zeros(lambda p: p.startswith("00"))
    return (F.when(bytes_.startswith("FFFE") | (low > up), "UTF-16LE").when(bytes_.startswith("FEFF") | (up > low), "UTF-16BE")
             .when(utf8, "UTF-8").when(high, "WINDOWS-1252").otherwise("ISO-8859-1"))


def separator_of(header: Column) -> Column:
    """A1: the first of , ; tab | that splits the header in more than one column;
    else the first of : ^ ~ # * that stands between two names; else a comma.
    What stands in quotes splits nothing."""
    header = F.regexp_replace(header, '"[^"]*("|$)', '"')
    sep = F.coalesce(*[F.when(F.contains(header, F.lit(s)), F.lit(s)) for s in SEPARATORS],
                     F.regexp_extract(header, r"[\p{L}\p{N}_\"] *([:^~#*]) *[\p{L}\p{N}_\"]", 1))
    return F.when(sep == "", F.lit(",")).otherwise(sep)


def read_forms(forms: DataFrame, path: str, read, cols: list[str]) -> DataFrame:
    """Union by name of ``read(paths, form)`` over the distinct forms of the files."""
    forms = materialize(forms)
    kinds = forms.select(*cols).distinct().orderBy(*cols).collect()
    if len(kinds) <= 1:
        return read(path, kinds[0] if kinds else None)
    parts = []
    for kind in kinds:
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(kind[c])) for c in cols])
        parts.append(read([r["file"] for r in forms.where(same).select("file").collect()], kind))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tagged(df: DataFrame) -> DataFrame:
    """Rows with their file, block and place in the scan, unless they bring a ``row_id``."""
    return df if "row_id" in df.columns else df.select("*", *place())


def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   encoding: str | None = None, input_order: bool = False) -> DataFrame:
    """A1 + A2: CSV/TXT; separator and encoding per file, line breaks and doubled quotes inside quotes."""
    def read(paths, form):
        kind = encoding or (form["encoding"] if form else "UTF-8")
        by = sep or (form["sep"] if form else ",")
        if form and not form["plain"] and not misaligned(paths, kind):
            df = read_records(spark, paths, kind, by, input_order)
            return df if input_order and "row_id" not in df.columns else df.drop("_file", "_block", "_id")
        df = (spark.read.option("header", True).option("sep", by).option("encoding", kind).option("escape", '"')
              .option("inferSchema", False).option("multiLine", kind.startswith("UTF-16")).csv(paths))
        return tagged(df) if input_order else df

    def misaligned(paths, kind: str) -> bool:
        """A line end found between two UTF-16 characters: such files are read whole, a task each."""
        return kind.startswith("UTF-16") and bool(spark.read.option("lineSep", LINE_ENDS[kind]).text(paths).where(F.octet_length("value") % 2 == 1).take(1))

    forms = first_lines(spark, path).withColumn("encoding", F.lit(encoding) if encoding else encoding_of(F.col("header"), F.col("utf8"), F.col("high")))
    text = F.coalesce(*[F.when(F.col("encoding") == e, decoded(F.col("header"), e)) for e in ENCODINGS], F.col("header"))
    plain = ~F.col("broken") & F.col("encoding").isin("UTF-8", "ISO-8859-1") & ~F.startswith(text, F.lit(MARK))
    forms = forms.select("file", (F.lit(sep) if sep else separator_of(text)).alias("sep"), "encoding", plain.alias("plain"))
    out = read_forms(forms, path, read, ["sep", "encoding", "plain"])
    return with_input_order(out) if input_order else out


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None, input_order: bool = False) -> DataFrame:
    """A3: JSON lines or documents that span lines (an array of records), told apart per file
    by the first line: a whole record there means lines."""
    def read(paths, form):
        many = multi_line if multi_line is not None else bool(form and form["many"])
        df = spark.read.option("multiLine", many).option("primitivesAsString", True).json(paths)
        return tagged(df) if input_order else df
    if multi_line is not None:
        out = read(path, None)
    else:
        head = F.trim("header")
        lines = (head.startswith("{") & head.endswith("}")) | (head == "")
        out = read_forms(first_lines(spark, path).select("file", (~lines).alias("many")), path, read, ["many"])
    return with_input_order(out) if input_order else out


def extension(path: str) -> str:
    p = path.rstrip("/")
    return os.path.splitext(p)[1].lower()


def load_data(spark: SparkSession, path: str, file_type: str | None = None, input_order: bool = False) -> DataFrame:
    """A4: dispatch by suffix; with ``input_order``, text files
    bring a ``row_id`` in (path, line) order.  Unsupported formats raise ``ValueError``;
    a missing path surfaces as Spark's PATH_NOT_FOUND error."""
    kind = (file_type or extension(path)).lower()
    if kind in (".csv", ".txt"):
        return read_delimited(spark, path, input_order=input_order)
    if kind == ".json":
        return read_json(spark, path, input_order=input_order)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".xlsx", ".xls"):
        raise ValueError(f"Formato de archivo no soportado en Spark: {kind}")
    raise ValueError(f"Formato de archivo no soportado: {kind}")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A5: name, size, size in MB, extension, modified, supported?

    The binary-file source prunes the ``content`` column when it is not
    selected, so only file metadata is listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.select(
        name.alias("name"), F.col("length").alias("size"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"), ext.alias("extension"),
        F.col("modificationTime").alias("modified"),
        ext.isin(SUPPORTED).alias("is_supported"))
