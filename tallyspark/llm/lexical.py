"""Ranked lexical search on a length-stratified index.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in the whole text, with
A-Z lower-cased, as 64-bit hashes.  N documents hold a term at all, L is the number of all their terms.
A document of n terms has the normaliser m = 75 + (25 * n * N) div L.  A term held by df documents has
the weight w = floor(1000 * ln((2N + 2) / (2df + 1))); it adds w * ((10**9 * tf) div (1000 * tf + 12 * m))
for every time that the item names it.

Index: documents of equal m are a stratum.  A stratum is cut into cells of about CELL_POSTINGS
postings by a number of the row, so that one of any size is spread.  A cell is one row of the index
table: its documents, its terms in order, and for each term the documents by falling tf.  Since m and tf
are equal inside such a group, a term's impact is computed once per tf and not per document.

Search: items are read in blocks of at most about BLOCK_TERMS terms; a block is broadcast and released
when its results are written.  A task bounds every cell for every item by the impacts of the largest tf,
visits cells by falling bound, and leaves out the items whose 20th best score so far lies above it.
Scores are exact: no document that could enter is left out.

Defined results: null texts and texts without terms are no documents; items without terms find nothing;
a document without an id is found with a null id, after all others of its score; repeated rows are
documents of their own, repeated items are ranked each; terms that no document holds add nothing; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.arrow import shared, small_batches, utf8
from tallyspark.llm.best import MOST, Best
from tallyspark.llm.minhash import by_cell
from tallyspark.llm.words import WordHasher
from tallyspark.llm.work import Workspace

TOP = 20
CELL_POSTINGS = 1 << 18
BLOCK_TERMS = 1 << 18
PAIRS = 1 << 20
FORWARD = "id bigint, n bigint, terms array<bigint>, tfs array<int>"
CELL = "m bigint, docs array<bigint>, terms array<bigint>, first array<int>, tfs array<int>, start array<int>, posts array<int>"
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def term_hasher() -> WordHasher:
    inside = np.zeros(256, bool)
    inside[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = inside[128:] = True
    fold = np.arange(256)
    fold[65:91] += 32
    return WordHasher(inside, fold)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, number of terms, distinct terms and their frequencies, of rows (id, text)."""
    hashed = term_hasher()
    for batch in batches:
        words, firsts = hashed.words(*utf8(batch.column(1)))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
        order = np.lexsort((words, owner))
        words, owner = words[order].view(np.int64), owner[order]
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        sizes = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = lambda x: pa.ListArray.from_arrays(sizes, pa.array(x))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(firsts)), lists(words[at]), lists(np.diff(np.append(at, len(words))).astype(np.int32))], ["id", "n", "terms", "tfs"])


def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index row per cell, from sorted rows (m, block, id, terms, tfs)."""
    def cell(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column("terms").chunk(0)
        terms, tfs = lists.flatten().to_numpy(), table.column("tfs").chunk(0).flatten().to_numpy()
        doc = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        order = np.lexsort((doc, -tfs, terms))
        terms, tfs, doc = terms[order], tfs[order], doc[order]
        new_term = np.append(True, terms[1:] != terms[:-1])
        group = np.flatnonzero(new_term | np.append(True, tfs[1:] != tfs[:-1]))
        first = np.append(np.flatnonzero(new_term[group]), len(group))
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([table.column("m")[0].as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(lists)], table.column("id").chunk(0)), one(terms[new_term], pa.int64()), one(first, pa.int32()),
                                           one(tfs[group], pa.int32()), one(np.append(group, len(terms)), pa.int32()), one(doc, pa.int32())], ["m", "docs", "terms", "first", "tfs", "start", "posts"])

    held: list[pa.RecordBatch] = []
    for new, part in by_cell(batches, ["m", "block"]):
        if new and held:
            yield cell(held)
            held = []
        held.append(part)
    if held:
        yield cell(held)


@dataclass
class Index:
    cells: DataFrame
    documents: int
    terms: int


def build_index(work: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    forward = work.save(source.mapInArrow(count_terms, FORWARD).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "forward")
    documents, terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranked = forward.withColumn("m", F.expr(f"75 + (25 * n * {documents}L) div {max(terms, 1)}L"))
    strata = work.save(ranked.groupBy("m").agg(F.greatest(F.ceil(F.sum(F.size("terms")) / CELL_POSTINGS), F.lit(1)).alias("blocks")), "strata")
    dealt = ranked.join(strata, "m").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))).repartition("m", "block").sortWithinPartitions("m", "block")
    cells = work.save(dealt.select("m", "block", "id", "terms", "tfs").mapInArrow(invert, CELL), "cells")
    work.drop(forward, strata)
    return Index(cells, documents, terms)


class Items:
    """A block of items: their distinct terms, and (item, term, times) entries by item."""

    def __init__(self, table: pa.Table):
        lists = table.column("terms").combine_chunks()
        self.q, self.vocabulary = table.column("q").to_numpy(), np.unique(lists.flatten().to_numpy())
        self.item = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        self.term = np.searchsorted(self.vocabulary, lists.flatten().to_numpy())
        self.times = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, held: pa.Table, documents: int) -> None:
        for term, df in zip(held.column("term").to_pylist(), held.column("df").to_pylist(), strict=True):
            self.weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def holders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of the task's cells that hold each term."""
        total = np.zeros(len(self.vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = Cell(batch, row, self.vocabulary)
                total[cell.known] += cell.start[cell.last] - cell.start[cell.first]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "n"])

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """The task's best k documents of each item."""
        best = Best(len(self.q), k)
        for batch in batches:
            cells = [Cell(batch, row, self.vocabulary) for row in range(batch.num_rows)]
            bounds = [self.bound(c) for c in cells]
            for at in sorted(range(len(cells)), key=lambda c: -bounds[c].max(initial=0)):
                self.visit(cells[at], bounds[at], best)
        item = np.repeat(np.arange(len(self.q)), best.filled)
        place = np.arange(k)[None, :] < best.filled[:, None]
        ids = best.id[place]
        yield pa.RecordBatch.from_arrays([pa.array(self.q[item]), pa.array(ids, mask=ids == MOST), pa.array(best.score[place])], ["q", "doc_id", "score"])

    def bound(self, cell: Cell) -> np.ndarray:
        """At most this score has any document of the cell, per item."""
        cell.weigh(self.weight)
        most = np.zeros(len(self.vocabulary), np.int64)
        most[cell.known] = cell.impact[cell.first]
        total = np.zeros(len(self.q), np.int64)
        np.add.at(total, self.item, self.times * most[self.term])
        return total

    def visit(self, cell: Cell, bound: np.ndarray, best: Best) -> None:
        """Score the cell's documents for the items that they may still enter."""
        wanted = (bound > 0) & (bound >= best.floor)
        place = np.full(len(self.vocabulary), -1)
        place[cell.known] = np.arange(len(cell.known))
        entry = np.flatnonzero(wanted[self.item] & (place[self.term] >= 0))
        if not len(entry):
            return
        posted = place[self.term[entry]]
        lo = cell.start[cell.first][posted]
        size = cell.start[cell.last][posted] - lo
        n = len(cell.docs)
        reach = np.cumsum(size)
        owner = self.item[entry]
        cuts = [0]  # whole items, about PAIRS pairs and PAIRS sums at a time
        for k in np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1:
            if reach[k - 1] - (reach[cuts[-1] - 1] if cuts[-1] else 0) >= PAIRS or (owner[k - 1] - owner[cuts[-1]] + 1) * n >= PAIRS:
                cuts.append(int(k))
        if cuts[-1] != len(entry):
            cuts.append(len(entry))
        exact = bound.max() < 1 << 53
        impact = np.repeat(cell.impact, np.diff(cell.start))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sizes = size[a:b]
            post = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            base = owner[a]
            key = np.repeat((owner[a:b] - base) * n, sizes) + cell.posts[post]
            value = impact[post] * np.repeat(self.times[entry[a:b]], sizes)
            width = (owner[b - 1] - base + 1) * n
            if exact:
                score = np.bincount(key, value, width).astype(np.int64)
            else:
                score = np.zeros(width, np.int64)
                np.add.at(score, key, value)
            found = np.flatnonzero((score > 0) & (score >= np.repeat(best.floor[base:owner[b - 1] + 1], n)))
            if len(found):
                best.add(base + found // n, score[found], cell.docs[found % n])


class Cell:
    """A row of the index, seen through the items' vocabulary."""

    def __init__(self, batch: pa.RecordBatch, row: int, vocabulary: np.ndarray):
        values = lambda c: batch.column(c)[row].values
        self.m, self.docs = batch.column("m")[row].as_py(), values("docs").fill_null(MOST).to_numpy()
        terms, first = values("terms").to_numpy(), values("first").to_numpy()
        self.tfs, self.start, self.posts = values("tfs").to_numpy(), values("start").to_numpy().astype(np.int64), values("posts").to_numpy()
        at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
        self.known = np.flatnonzero(terms[at] == vocabulary)  # numbers of the vocabulary's terms that the cell holds
        self.first, self.last = first[at[self.known]], first[at[self.known] + 1]  # their groups of equal tf
        self.impact = np.zeros(len(self.tfs), np.int64)

    def weigh(self, weight: np.ndarray) -> None:
        """Impact of each group: once per term and tf."""
        tf = self.tfs.astype(np.int64)
        size = self.last - self.first
        group = np.repeat(self.first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        self.impact[group] = np.repeat(weight[self.known], size) * ((1_000_000_000 * tf[group]) // (1000 * tf[group] + 12 * self.m))


def search(work: Workspace, index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = items.sparkSession
    source = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = work.save(source.mapInArrow(count_terms, FORWARD).where("n > 0").withColumn("q", F.monotonically_increasing_id()), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    out, kept = spark.createDataFrame([], RESULT), []
    for part in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == part)
        table = block.select("q", "terms", "tfs").toArrow().sort_by("q")
        if not table.num_rows:
            continue
        made = Items(table)
        with shared(spark, made) as given:
            held = index.cells.mapInArrow(lambda batches: given().holders(batches), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df")).toArrow()  # the block's terms at most
        made.weigh(held, index.documents)
        with shared(spark, made) as given:
            found = work.save(index.cells.mapInArrow(lambda batches: given().search(batches, k), "q bigint, doc_id bigint, score bigint"), "found")
        order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kept.append(work.save(best.join(block.select("q", F.col("id").alias("item_id")), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))
        out = out.unionByName(kept[-1])
        work.drop(found)
    work.drop_all_but(*kept)
    return out


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    work = Workspace(docs.sparkSession, "lexical")
    return search(work, build_index(work, docs), items)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({LOWER}, '{TERM}') as terms from documents),
size as (select count(*)::bigint as docs, sum(len(terms))::bigint as total from d where len(terms) > 0),
doc as materialized (select r, doc_id, 75 + (25 * len(terms) * docs) // total as m from d, size where len(terms) > 0),
post as materialized (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) group by r, term),
weight as materialized (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from post, size group by term, docs),
item as (select row_number() over () as q, item_id, regexp_extract_all({LOWER}, '{TERM}') as terms from benchmark),
asked as materialized (select q, term, count(*)::bigint as times from (select q, unnest(terms) as term from item) group by q, term),
score as (select q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from asked join weight using (term) join post using (term) join doc using (r) group by q, r)
select item_id, (row_number() over (partition by q order by score desc, doc_id nulls last))::int as rank, doc_id, score
from score join item using (q) join doc using (r) where score > 0 qualify row_number() over (partition by q order by score desc, doc_id nulls last) <= {TOP}"""
