"""Delimited records whose quoted fields hold line breaks (A1), in any of five encodings (A2).

A file is cut into lines wherever Spark cuts it into blocks, so it stays splittable.  What a line does
to the quotes is a function of two states: where does it end if it begins outside quotes (f0), and where if
it begins inside (f1)?  Such functions compose in any grouping, so the state is carried in three steps:
along the lines of a part, along the part sums of a file (one row per part), and back to the lines.
A part is at most 2 ** PART_BITS neighbouring lines of a block, so that no task has to hold a block.
Lines that begin inside quotes belong to the record of the line before.

A quote opens a field only at the field's start and a doubled one inside a quoted field stands for itself,
as in common CSV readers; so a stray inch mark opens nothing.  A quote that never closes in its file
opens nothing either: from that record on lines are records of their own.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.session import materialize

# the 27 characters that Windows-1252 has in place of the control codes 0x80-0x9F (fixed values)
C1_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
C1_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
MARK = "﻿"
LINE_ENDS = {"UTF-16LE": "\n\0", "UTF-16BE": "\0\n"}
PART_BITS = 13
# states inside a line
MIDDLE, START, QUOTED, CLOSED = 0, 1, 2, 3


def decoded(raw: Column, encoding: str) -> Column:
    """Text of a line's raw bytes."""
    if encoding == "UTF-8":
        return raw
    if encoding.startswith("UTF-16"):
        size = F.octet_length(raw)  # a first line cut at the byte 0A of 00 0A has a byte too many
        return F.decode(F.substring(raw.cast("binary"), F.lit(1), size - size % 2), encoding)
    text = F.decode(raw.cast("binary"), "ISO-8859-1")
    return F.translate(text, C1_CODES, C1_CHARS) if encoding == "WINDOWS-1252" else text


def ends_quoted(text: Column, sep: Column, inside: bool) -> Column:
    """Does a line that begins inside, or outside, quotes end inside them?

    The line is cut at its quotes; each quote and the piece after it move one of four states.
    """
    pieces = F.split(text, '"', -1)
    after = lambda p: F.when(p.endswith(sep), START).otherwise(MIDDLE)
    first = F.element_at(pieces, 1)
    begin = F.lit(QUOTED) if inside else F.when(first == "", START).otherwise(after(first))
    step = lambda state, p: (F.when((state == START) | (state == CLOSED), QUOTED)
                              .when(state == QUOTED, F.when(p == "", CLOSED).otherwise(after(p)))
                              .otherwise(after(p)))
    return F.aggregate(F.slice(pieces, 2, 1 << 30), begin, step) == QUOTED


def opens(text: Column, seps: list[str]) -> Column:
    """Does the line open a quote that it doesn't close, under any of the separators?"""
    quoted = F.exists(F.array(*map(F.lit, seps)), lambda s: ends_quoted(text, s, False))
    return F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.lit(False))


def with_state(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """From each row's function (known, value): ``before`` and ``after``, the compositions up to it, as structs."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_flips", F.sum(F.when(~F.col("known"), F.col("value")).otherwise(0)).over(w))
    df = df.withColumn("_fixed", F.last(F.when(F.col("known"), F.struct(F.col("value").alias("v"), F.col("_flips").alias("at"))), ignorenulls=True).over(w))
    value = F.coalesce(F.col("_fixed.v") + F.col("_flips") - F.col("_fixed.at"), F.col("_flips")) % 2
    df = df.withColumn("after", F.struct(F.col("_fixed").isNotNull().alias("known"), value.cast("int").alias("value"))).drop("_flips", "_fixed")
    none = F.struct(F.lit(False).alias("known"), F.lit(0).alias("value"))
    return df.withColumn("before", F.coalesce(F.lag("after").over(w), none))


def applied(function: str, state: Column) -> Column:
    return F.when(F.col(f"{function}.known"), F.col(f"{function}.value")).otherwise((F.col(f"{function}.value") + state) % 2)


def records(spark: SparkSession, paths, encoding: str, sep: str) -> DataFrame:
    """(file, block, id, record): the records of text files that are not blank, each with the place of its first line."""
    lines = spark.read.option("lineSep", LINE_ENDS.get(encoding, "\n")).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), decoded(F.col("value"), encoding).alias("text"))
    text, s = F.col("text"), F.lit(sep)
    has = F.contains(text, F.lit('"'))
    f0 = F.when(has, ends_quoted(text, s, False)).otherwise(F.lit(False)).cast("int")
    f1 = F.when(has, ends_quoted(text, s, True)).otherwise(F.lit(True)).cast("int")
    # known: both states end alike; otherwise value says whether the state flips
    lines = lines.withColumn("_f", F.struct(f0.alias("f0"), f1.alias("f1")))
    lines = lines.withColumn("known", F.col("_f.f0") == F.col("_f.f1")).withColumn("value", F.col("_f.f0")).drop("_f")
    lines = lines.withColumn("part", F.struct("block", F.shiftright("id", PART_BITS).alias("n")))
    tracked = materialize(with_state(lines, ["file", "part"], ["id"]).drop("known", "value"))
    # one row per part
    parts = tracked.groupBy("file", "part").agg(F.max_by("after", "id").alias("f"))
    parts = with_state(parts.select("file", "part", F.col("f.known").alias("known"), F.col("f.value").alias("value")), ["file"], ["part"])
    parts = parts.select("file", "part", applied("before", F.lit(0)).alias("carry"), applied("after", F.lit(0)).alias("left"))
    open_files = parts.groupBy("file").agg(F.max_by("left", "part").alias("unclosed"))
    rows = tracked.join(parts.select("file", "part", "carry"), ["file", "part"]).withColumn("inside", applied("before", F.col("carry")))
    begun = rows.where("inside = 0").groupBy("file").agg(F.max(F.struct("block", "id")).alias("last")).join(open_files, "file").where("unclosed = 1").select("file", "last")
    rows = rows.join(begun, "file", "left").withColumn("begins", (F.col("inside") == 0) | F.coalesce(F.struct("block", "id") > F.col("last"), F.lit(False)))
    rows = materialize(rows.select("file", "part", "block", "id", "text", "begins"))
    line = Window.partitionBy("file", "part").orderBy("id")
    rows = rows.withColumn("k", F.sum(F.col("begins").cast("int")).over(line))
    counts = rows.groupBy("file", "part").agg(F.max("k").alias("n"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "part", F.last(F.when(F.col("n") > 0, F.struct("part", F.col("n").alias("k"))), ignorenulls=True).over(earlier).alias("open"))
    rows = rows.join(counts, ["file", "part"]).withColumn("owner", F.when(F.col("k") > 0, F.struct("part", "k")).otherwise(F.col("open")))
    whole = rows.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "id", "text"))).alias("parts"))
    record = F.regexp_replace(F.array_join("parts.text", "\n"), "\r$", "")
    first = F.element_at("parts", 1)
    return whole.select("file", first["block"].alias("block"), first["id"].alias("id"), F.regexp_replace(record, f"^{MARK}", "").alias("record")) \
                .where(F.length(F.trim("record")) > 0)


def names_of(header: str, sep: str) -> list[str]:
    """Column names of a header record; empty and repeated names as Spark's CSV reader makes them."""
    names = next(csv.reader(io.StringIO(header, newline=""), delimiter=sep))
    lower = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if lower.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def read_records(spark: SparkSession, paths, encoding: str, sep: str, places: bool) -> DataFrame:
    """All records as strings under their file's header; with ``places`` also ``_file``, ``_block`` and ``_id``."""
    found = materialize(records(spark, paths, encoding, sep))
    heads = found.groupBy("file").agg(F.min(F.struct("block", "id", "record")).alias("head"))
    rows = found.join(heads, "file").where(F.struct("block", "id") > F.struct("head.block", "head.id"))
    parts = []
    for (header,) in heads.select("head.record").distinct().orderBy("record").collect():  # one row per form of header
        names = names_of(header, sep)
        ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names)))}
        row = F.from_csv("record", ddl, options).alias("_row")
        tag = [F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("id").alias("_id")] if places else []
        parts.append(rows.where(F.col("head.record") == header).select(row, *tag).select("_row.*", *[c for c in ("_file", "_block", "_id") if places]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "_c0 string")
