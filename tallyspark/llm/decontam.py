"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a text with up to k = floor(m * ERROR_RATE) edits.  Split
into k + 1 pieces, at least one piece then occurs unchanged; an Aho-Corasick automaton finds every
piece in one pass over the text, each hit gives the place where the whole item would start, and
Myers' bit-parallel algorithm computes the edit distance around that place.

Texts and items are lower-cased and runs of white space become one blank; whole texts are searched.

The items are read by the driver in blocks of about BLOCK_CHARS characters.  One block at a time is
broadcast and searched for in every text; what it found is written before the next block is read, so that
neither driver nor workers hold more than one, however many items there are.

An item shorter than MIN_CHARS characters after normalising is no passage that edits could leave
recognisable: it matches unchanged only, and between word borders.

Defined results: items that are null or blank match nothing; an item without an id is reported with a null id; null and empty texts match nothing; of equal items all match; repeated
rows get equal results; an empty benchmark matches nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import share, shared, small_batches, strings
from tallyspark.llm.work import Workspace

ERROR_RATE = 0.08
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
MATCH = "array<struct<item_id: bigint, distance: int>>"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return int(m * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def stands_alone(text: str, a: int, b: int) -> bool:
    """Is text[a:b] cut off by word borders where it begins or ends with a letter or digit?"""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, k: int) -> int:
    """Least edit distance of the pattern to any substring of ``text``; k + 1 if above k."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        hp = down | (full & ~(d0 | up))
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best = score
            if not best:
                return 0
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up = hn | (full & ~(d0 | hp))
        down = hp & d0
    return best if best <= k else k + 1


class Searcher:
    """Automaton and bit masks of one block of items; built where it is used."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        places: dict[str, list[tuple[int, int]]] = {}
        self.items = [(i, t, budget(len(t), rate) if len(t) >= MIN_CHARS else 0) for i, t in items]
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                places.setdefault(piece, []).append((n, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item_id, edit distance) of every item that the text holds."""
        if not self.items:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for n, offset in where:
                at = end + 1 - offset
                if len(self.items[n][1]) >= MIN_CHARS or stands_alone(text, at, end + 1):
                    starts.setdefault(n, set()).add(at)
        found = []
        for n, at in starts.items():
            item, pattern, k = self.items[n]
            if (d := self.distance(n, pattern, k, text, sorted(at))) <= k:
                found.append((item, d))
        return sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[1]))

    def distance(self, n: int, pattern: str, k: int, text: str, starts: list[int]) -> int:
        m, best, at = len(pattern), k + 1, 0
        while at < len(starts):  # hits near each other share a window
            lo = hi = starts[at]
            at += 1
            while at < len(starts) and starts[at] <= hi + k:
                hi = starts[at]
                at += 1
            window = text[max(0, lo - k):hi + m + k]
            if pattern in window:
                return 0
            if len(window) >= m - k:
                best = min(best, myers(self.masks.setdefault(n, peq(pattern)), m, window, k))
        return best


def distinct_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Different (item_id, text) and the number of blocks that they take."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return items, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)


def item_block(items: DataFrame, k: int, n: int) -> list[tuple[int | None, str]]:
    """Block k of n: normalised items by id."""
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
    return sorted(((r.item_id, t) for r in rows if (t := normal(r.text))), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def searched(given: Callable[[], list[tuple[int | None, str]]], text: Column, rate: float) -> Column:
    """Column of the given items that a text holds."""
    @F.arrow_udf(MATCH)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(given(), rate)
        for batch in batches:
            rows = [[{"item_id": i, "distance": d} for i, d in searcher.find(t)] for t in strings(batch)]
            yield pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])))

    return search.asNondeterministic()(text)


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The documents with a column of the items that their text holds, as array<struct<item_id, distance>>."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "decontam")
    items, n = distinct_items(benchmark)
    found = docs.withColumn(name, F.array().cast(MATCH))
    for k in range(n):
        block = item_block(items, k, n)
        if k + 1 == n:  # the last one is searched for when the result is read
            return found.withColumn(name, F.concat(name, searched(share(spark, block), F.col(text_col), rate)))
        with shared(spark, block) as given:
            before, found = found, work.save(found.withColumn(name, F.concat(name, searched(given, F.col(text_col), rate))), "found")
        work.drop(before)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and least distance, one row per document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, "_found")
    return found.select("doc_id", (F.size("_found") > 0).alias("contaminated"), F.size("_found").cast("long").alias("n_items"),
                        F.sort_array("_found.item_id").alias("item_ids"), F.array_min("_found.distance").alias("least_distance"))
