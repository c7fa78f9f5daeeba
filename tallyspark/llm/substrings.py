"""Substring dedup on a compacted De Bruijn graph of token windows.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text, unchanged.  A window (WINDOW consecutive words) is an
edge of the graph, from its first WINDOW - 1 words to its last WINDOW - 1.  A word goes if a window
covers it that also starts in a document with a smaller doc_id.

1. Documents with equal word sequences are one class; its smallest doc_id stands for it, all others
   repeat it as a whole.
2. Each window's minimiser (the least hash of its GRAM-word runs) is equal wherever the window occurs.
   Only windows whose minimiser occurs in several classes become edges; nothing repeated is lost.
3. Edges are aggregated: smallest source coordinate, number of occurrences, and a fingerprint of the
   set of their places.  Two edges that follow each other in their source lie on one nonbranching
   path if the places of the second are those of the first, moved by one word.
4. Such paths are compacted, and only their first and last edges meet the occurrences again, by a
   join: one row per document and path, not per window.  A span is verified by its coordinates: the
   first and the last edge must lie in the document as far apart as in the source.  A path that
   fails (fingerprints are 32 bits) is taken apart into its edges.
5. The spans of a document are removed from its words in one more pass over the texts that have any.

Coordinates are (rank of the class by doc_id, word number) in one 64-bit number.  Texts move only to
meet their own spans; hot passages are pre-aggregated before the shuffle and their occurrences are the
hot side of a plain join of written tables, which Spark splits.

Defined results: a null or wordless text has 0 words; a null doc_id counts as greater than all others,
and two null ones as equal, as do rows that share a doc_id: neither is the other's source; repeated
rows get equal results; texts under WINDOW words stay whole; texts of any length are read whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.arrow import SPACE_BYTES, small_batches, strings, utf8
from tallyspark.llm.byid import split
from tallyspark.llm.words import WordHasher, grams, sliding_min
from tallyspark.llm.work import Workspace
from tallyspark.operators.order import global_rank

WINDOW = 13
GRAM = 5
EDGE, PIECE = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
NOTHING = hashlib.sha256(b"").hexdigest()
SPAN = "array<struct<start: bigint, end: bigint, source_id: bigint, source_start: bigint>>"
SKETCH = "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, d1 bigint, d2 bigint, sha string, pieces array<bigint>"


def hasher() -> WordHasher:
    inside = np.ones(256, bool)
    inside[list(SPACE_BYTES)] = False
    return WordHasher(inside)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def windows(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Edge and minimiser of the window that starts at each word; windows may cross rows."""
    small = min(GRAM, window)
    return grams(words, window, EDGE), sliding_min(grams(words, small, PIECE), window - small + 1)


def sketch(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per row: number of words, digest of the word sequence, and its distinct minimisers."""
    hashed = hasher()
    for batch in batches:
        raw, offsets = utf8(batch.column(3))
        words, firsts = hashed.words(raw, offsets)
        _, least = windows(words, window)
        digests, found = [], []
        data = raw.tobytes()
        for a, b, lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            digests.append(hashlib.sha256(b" ".join(data[a:b].split())).digest())  # bytes.split knows the same blanks
            found.append(np.unique(least[lo:hi - window + 1]) if hi - lo >= window else least[:0])
        parts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 4)
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(sizes, signed(np.concatenate([*found, least[:0]])))
        yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(pa.int64()) for k in range(3)], pa.array(np.diff(firsts)), pa.array(parts[:, 0]), pa.array(parts[:, 1]),
                                          pa.array([d.hex() for d in digests]), lists], ["doc_id", "k1", "k2", "n_words", "d1", "d2", "sha", "pieces"])


def edges(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(edge, place) of every window whose minimiser is among the row's shared ones."""
    hashed = hasher()
    for batch in batches:
        rid = batch.column("rid").to_numpy()
        words, firsts = hashed.words(*utf8(batch.column("text")))
        edge, least = windows(words, window)
        shared = batch.column("shared")
        for k, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)):
            if hi - lo < window:
                continue
            pos = np.flatnonzero(np.isin(least[lo:hi - window + 1], shared[k].values.to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([signed(edge[lo + pos]), pa.array((rid[k] << bits) + pos)], ["edge", "place"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: number of words in its spans, and the digest of the others."""
    for batch in batches:
        counts, digests = [], []
        for text, spans in zip(strings(batch.column("text")), batch.column("spans"), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, spans.values.field("start").to_numpy(), 1)
            np.add.at(edge, spans.values.field("end").to_numpy(), -1)
            gone = np.cumsum(edge[:-1]) > 0
            counts.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("spans"), pa.array(counts, pa.int64()), pa.array(digests)], ["rid", "spans", "n_removed", "kept_sha256"])


def fingerprint(place: Column) -> Column:
    """32 bits of a place, and 32 bits of the place one word further."""
    return F.shiftleft(F.xxhash64(place), 32).bitwiseXOR(F.xxhash64(place + 1).bitwiseAND(F.lit(0xFFFFFFFF)))


def classes_of(sketches: DataFrame, window: int) -> DataFrame:
    """Classes of equal word sequences, ranked by doc_id (null: last), with the first rank of equal ids."""
    source = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")).alias("source")
    found = sketches.where(F.col("n_words") >= window).groupBy("d1", "d2", "n_words").agg(source).select("d1", "d2", "n_words", "source.*")
    ranked = global_rank(found, ["nameless", "doc_id", "k1", "k2"], "rid")
    named = ranked.where("not nameless").count()
    twice = ranked.where("not nameless").groupBy("doc_id").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = F.when(F.col("nameless"), F.lit(named)).otherwise(F.coalesce("first", "rid"))
    return ranked.join(twice, "doc_id", "left").select("rid", first.alias("first"), "doc_id", "k1", "k2", "d1", "d2", "n_words")


def paths_of(graph: DataFrame, bits: int) -> DataFrame:
    """(edge, source, path, head, tail): a path is named by the source coordinate of its first edge."""
    order = W.partitionBy(F.shiftright("source", bits)).orderBy("source")
    follows = (F.lag("source").over(order) + 1 == F.col("source")) & (F.lag("mark").over(order).bitwiseAND(F.lit(0xFFFFFFFF)) == F.shiftrightunsigned("mark", 32))
    marked = graph.select("edge", "source", (~F.coalesce(follows, F.lit(False))).alias("head"))
    path = F.max(F.when(F.col("head"), F.col("source"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    tail = F.coalesce(F.lead("head").over(order), F.lit(True))
    return marked.select("edge", "source", "head", tail.alias("tail"), path.alias("path"))


def spans_of(work: Workspace, placed: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, start, length): where documents run along a path, from its first to its last edge."""
    ends = work.save(paths.where("head or tail").select("edge", "path", (F.col("source") - F.col("path")).alias("at"), "head", "tail"), "ends")
    met = placed.join(ends, "edge").select("path", (F.col("place") - F.col("at")).alias("start"), "head", F.when(F.col("tail"), F.col("at") + 1).alias("length"))
    return work.save(met.groupBy("path", "start").agg(F.max("head").alias("head"), F.max("length").alias("length")), "spans")


def repeated_spans(work: Workspace, placed: DataFrame, bits: int) -> DataFrame:
    """(source, start, length) in windows of all verified spans; coordinates are places."""
    count = F.count("*").alias("n")
    graph = placed.groupBy("edge").agg(F.min("place").alias("source"), F.bit_xor(fingerprint(F.col("place"))).alias("mark"), count).where("n > 1")
    paths = work.save(paths_of(graph, bits), "paths")
    found = spans_of(work, placed, paths)
    broken = work.save(found.where("not head or length is null").select("path").distinct(), "broken")
    sound = found
    if broken.take(1):  # such paths are taken apart: every edge is a path of its own
        single = paths.join(broken, "path", "left_semi").select("edge", "source", F.lit(True).alias("head"), F.lit(True).alias("tail"), F.col("source").alias("path"))
        sound = found.join(broken, "path", "left_anti").unionByName(spans_of(work, placed, work.save(single, "single")))
    return sound.select(F.col("path").alias("source"), "start", "length")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (in words, with their source) for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "substrings")
    doc_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), doc_id, text).alias("k2"), text.alias("text"))
    sketches = work.save(source.mapInArrow(lambda batches: sketch(batches, window), SKETCH), "sketches")
    classes = work.save(classes_of(sketches, window), "classes")
    bits = int(classes.agg(F.max("n_words")).first()[0] or 1).bit_length() + 1

    pieces = work.save(sketches.where(F.col("n_words") >= window).select("k1", "k2", "pieces").dropDuplicates(["k1", "k2"]).join(classes.select("k1", "k2", "rid"), ["k1", "k2"]).select("rid", "pieces"), "pieces")
    piece = pieces.select("rid", F.explode("pieces").alias("piece"))
    shared = work.save(piece.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1").select("piece"), "shared")
    wanted = piece.join(shared, "piece").groupBy("rid").agg(F.collect_list("piece").alias("shared"))  # no longer than its text
    wanted = work.save(wanted.join(classes.select("rid", "k1", "k2"), "rid"), "wanted")
    work.drop(pieces, shared)

    def texts_of(rows: DataFrame) -> DataFrame:
        few, _ = split(source, rows.select("k1"), "k1")
        return few.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(rows, ["k1", "k2"])

    placed = work.save(texts_of(wanted).select("rid", "shared", "text").mapInArrow(lambda batches: edges(batches, window, bits), "edge bigint, place bigint"), "placed")
    found = repeated_spans(work, placed, bits)
    part = lambda c: F.shiftright(c, bits)
    word = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    found = found.where(part("start") != part("source")).select(part("start").alias("rid"), part("source").alias("other"), word("start").alias("start"), (word("start") + F.col("length") + window - 1).alias("end"), word("source").alias("source_start"))
    own = found.join(classes.select("rid", "first"), "rid").where(F.col("other") < F.col("first"))
    own = own.join(classes.select(F.col("rid").alias("other"), F.col("doc_id").alias("source_id")), "other")
    per = own.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "source_id", "source_start"))).alias("spans"))
    per = work.save(per.join(classes.select("rid", "k1", "k2"), "rid"), "per")
    cut = texts_of(per).select("rid", "spans", "text").mapInArrow(removed, f"rid bigint, spans {SPAN}, n_removed bigint, kept_sha256 string")
    of_class = work.save(classes.select("rid", "d1", "d2", "n_words", F.col("doc_id").alias("class_id")).join(work.save(cut, "cut"), "rid", "left").drop("rid"), "of_class")

    rows = sketches.select("doc_id", "n_words", "d1", "d2", "sha").join(of_class, ["d1", "d2", "n_words"], "left")
    copy = F.col("class_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("class_id"))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"), F.col("class_id").alias("source_id"), F.lit(0).cast("bigint").alias("source_start")))
    out = work.save(rows.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
                                F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                                F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(SPAN))).alias("spans")), "result")
    work.drop_all_but(out)
    return out


ORACLE = rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (select r, doc_id, words, unnest(range(len(words) - {WINDOW - 1})) as pos from w where len(words) >= {WINDOW}),
g as (select r, doc_id, pos, array_to_string(words[pos + 1:pos + {WINDOW}], ' ') as win from p),
f as (select win, min(doc_id) as least from g group by win),
k as (select unnest(range({WINDOW})) as step),
gone as (select distinct g.r, g.pos + k.step as place from g join f using (win) cross join k where f.least < g.doc_id or (g.doc_id is null and f.least is not null)),
n as (select r, list(place) as places from gone group by r)
select doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
  sha256(array_to_string(case when places is null then words else list_filter(words, lambda x, i: not list_contains(places, i - 1)) end, ' ')) as kept_sha256
from w left join n using (r)"""
