"""Near-duplicates by b-bit MinHash.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set holds its distinct
five-word shingles (the whole sequence where there are fewer words), as 64-bit hashes.  Documents
are linked when 100 * intersection >= percent * union of their sets, with 85 percent unless told otherwise.

1. Sketch: HASHES minima per set.  ROWS minima make a band key; the low BITS bits of each minimum
   are packed into the signature.
2. Documents with equal sets become one class, whose smallest id represents it.
3. Per band bucket the representative that shares most buckets (the hub) is the candidate partner
   of all others.  Signatures give a collision-corrected estimate by bit counts; pairs that can't
   reach the threshold go, the others are confirmed on the full sets.
4. Components of these links.  Buckets that still hold several components are compared in blocks of
   signatures; what may link two components is again confirmed on the full sets.  So no pair of
   different components that share a bucket stays unexamined, and copies are never paired with
   each other one by one.
5. Components of all links; one row per document.

Bounds: a similarity of exactly 0.85 shares no bucket with probability (1 - 0.85**ROWS)**BANDS = 3e-7 (6e-5
at 0.80), and the margin of 4.5 standard deviations leaves out 3e-6 of the pairs at the threshold.  No bucket,
class or partner count is capped.  Tasks hold one block (BLOCK signatures or CELL sets) at a time; big buckets
are split into blocks.  What is aggregated by a key is written before it meets the key's rows again, so
that both sides of that join are plain scans and Spark can split a hot key.  Inside a bucket all that lies
outside its largest component is compared with all of the bucket: exact, in blocks, and quadratic where a
bucket holds many near misses.

Defined results: null and empty texts have an empty set, n_shingles 0, are linked with nothing and
kept; a row without a doc_id is linked with nothing, has a null component_id and is kept; repeated
rows get equal results, one row each; rows that share a doc_id but not the text are one node with the
links of all its texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import SPACE_BYTES, runs, small_batches, utf8
from tallyspark.llm.byid import among
from tallyspark.llm.components import components
from tallyspark.llm.work import Workspace

SHINGLE = 5
PERCENT = 85
ROWS, BANDS, BITS = 6, 32, 4
HASHES = ROWS * BANDS
BLOCK = 2048
CELL = 256
BYTES = 1 << 22

NIBBLES = 0x1111111111111111


def margin(percent: int = PERCENT) -> float:
    """4.5 standard deviations of the estimate at the threshold, with collisions by chance."""
    equal = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return 4.5 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns rows of UTF-8 text into sorted arrays of distinct shingle hashes."""

    STEP = 0x5851F42D4C957F2D  # odd, 5 modulo 8

    def __init__(self):
        lower = np.arange(256)
        lower[65:91] += 32
        self.byte = mix(lower.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.word = np.ones(256, bool)
        self.word[list(SPACE_BYTES)] = False
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            step, back = np.full(n, self.STEP, np.uint64), np.full(n, pow(self.STEP, -1, 1 << 64), np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and the n+1 word offsets of the rows."""
        self.powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.up[:len(raw)], out=total[1:])
        starts, ends = runs(self.word[raw], offsets)
        return mix((total[ends] - total[starts]) * self.down[starts]), np.searchsorted(starts, offsets)

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        raw, offsets = utf8(column)
        at = 0
        while at < len(column):  # some rows at a time, by bytes
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1)
            hashes, firsts = self.words(raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
            joined = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
            for k in range(SHINGLE):
                joined = joined * np.uint64(0x2545F4914F6CDD1D) + hashes[k:k + len(joined)]
            joined = mix(joined)
            for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                if hi - lo >= SHINGLE:
                    found = np.sort(joined[lo:hi - SHINGLE + 1])
                    yield found[np.concatenate([[True], found[1:] != found[:-1]])]
                elif hi > lo:
                    whole = np.array([hi - lo], np.uint64)
                    for h in hashes[lo:hi]:
                        whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
                    yield whole
                else:
                    yield np.zeros(0, np.uint64)
            at = to


def keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed random numbers of the hash functions."""
    seeds = mix(np.arange(1, 2 * HASHES + ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32)[:, None], (seeds[HASHES:2 * HASHES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), seeds[2 * HASHES:] | np.uint64(1)


def minima(shingles: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, ((short[None, at:at + 1024] ^ flip) * times).min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of scrambled minima, sixteen to a 64-bit word."""
    bits = mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    return np.bitwise_or.reduce(bits.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def band_keys(low: np.ndarray, factors: np.ndarray) -> np.ndarray:
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    return mix(mix(rows * factors + np.arange(BANDS, dtype=np.uint64)[:, None]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))


SKETCH = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sig array<bigint>"


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, (flip, times, factors) = Shingler(), keys()
    for batch in batches:
        n = batch.num_rows
        size, d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        bands, sigs = np.zeros((n, BANDS), np.uint64), np.zeros((n, HASHES * BITS // 64), np.uint64)
        for k, found in enumerate(shingler.sets(batch.column(1))):
            if size_k := len(found):
                low = minima(found, flip, times)
                size[k], d1[k], d2[k] = size_k, found.sum(), mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum()
                bands[k], sigs[k] = band_keys(low, factors), pack(low)
        lists = lambda x: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], pa.array(x.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(bands), lists(sigs)],
                                         ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: equal b-bit values, less those equal by chance."""
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(NIBBLES)))
    equal = 1 - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The same for blocks of signatures: len(one) x len(many)."""
    z = one[:, None, :] ^ many[None, :, :]
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    equal = 1 - np.bitwise_count(z & np.uint64(NIBBLES)).sum(axis=2, dtype=np.int64) / HASHES
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def by_cell(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of sorted batches that lie in one cell, and whether the cell is new."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            cell = tuple(cols[lo])
            yield cell != last, batch.slice(lo, hi - lo)
            last = cell


def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between side 0 and side 1 of each cell on full sets: one per row of side 1 at most."""
    shingler = Shingler()
    held: list[np.ndarray] = []
    names: list[int] = []
    index = None
    for new, part in by_cell(batches, ["a", "b", "i", "j"]):
        if new:
            held, names, index = [], [], None
        side, rep = part.column("side").to_numpy(), part.column("rep").to_numpy()
        xs, ys = [], []
        for k, found in enumerate(shingler.sets(part.column("text"))):
            if side[k] == 0:
                held.append(found)
                names.append(rep[k])
                index = None
                continue
            if not held or not len(found):
                continue
            if index is None:
                owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
                every = np.concatenate(held)
                order = np.argsort(every, kind="stable")
                index = every[order], owner[order], np.array([len(x) for x in held])
            lo, hi = np.searchsorted(index[0], found, "left"), np.searchsorted(index[0], found, "right")
            count = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            common = np.bincount(index[1][at], minlength=len(held))
            linked = np.flatnonzero(100 * common >= percent * (len(found) + index[2] - common))
            if len(linked):
                xs.append(names[linked[0]])
                ys.append(rep[k])
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])


MARKS = "a bigint, b bigint, side int, rep bigint"


def marks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From blocks of signatures: the representatives that may link two components.

    Against the bucket's largest component C, (C, C): its members are side 0, all others side 1, so
    that a block yields as many rows as it has, however many pairs they form.  Between two smaller
    components, (lo, hi): side 0 and side 1.
    """
    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows)
        query, top, rep, comp, size = (table.column(k).to_numpy() for k in ("query", "top", "rep", "comp", "n"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rep), -1)
        ask, all_ = np.flatnonzero(query == 1), np.flatnonzero(query == 0)
        got = []
        for at in range(0, len(ask), 64):
            q = ask[at:at + 64]
            small, large = np.minimum.outer(size[q], size[all_]), np.maximum.outer(size[q], size[all_])
            near = (comp[q][:, None] != comp[all_][None, :]) & (100 * small >= percent * large)
            near &= estimates(sig[q], sig[all_]) >= percent / 100 - margin(percent)
            i, j = np.nonzero(near)
            i, j = q[i], all_[j]
            main = top[j] == 1
            lo, hi = np.where(main, comp[j], np.minimum(comp[i], comp[j])), np.where(main, comp[j], np.maximum(comp[i], comp[j]))
            side_i, side_j = np.where(main, 1, comp[i] == hi), np.where(main, 0, comp[j] == hi)
            got.append(np.unique(np.concatenate([np.stack([lo, hi, side_i, rep[i]], 1), np.stack([lo, hi, side_j, rep[j]], 1)]), axis=0))
        if not sum(map(len, got)):
            return None
        found = np.unique(np.concatenate(got), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, k], pa.int32() if k == 2 else pa.int64()) for k in range(4)], ["a", "b", "side", "rep"])

    held: list[pa.RecordBatch] = []
    for new, part in by_cell(batches, ["key", "i", "j"]):
        if new and held:
            if (out := compare(held)) is not None:
                yield out
            held = []
        held.append(part)
    if held and (out := compare(held)) is not None:
        yield out


def blocks(n: Column, size: int) -> Column:
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def links_of(cells: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (x, y) of cells (a, b, i, j, side, rep)."""
    rows = cells.join(texts, "rep").repartition("a", "b", "i", "j").sortWithinPartitions("a", "b", "i", "j", "side")
    return rows.select("a", "b", "i", "j", "side", "rep", "text").mapInArrow(lambda batches: confirm(batches, percent), "x bigint, y bigint")


def star_cells(work: Workspace, pairs: DataFrame) -> DataFrame:
    """Cells of a hub and at most about CELL of its candidates."""
    sizes = work.save(pairs.groupBy("hub").agg(blocks(F.count("*"), CELL).alias("nb")), "sizes")
    held = pairs.join(sizes, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int").alias("j"))
    cell = lambda df, side, rep: df.select(F.col("hub").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("i"), "j", F.lit(side).alias("side"), F.col(rep).alias("rep"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    return cell(hubs, 0, "hub").union(cell(held, 1, "rep"))


def pair_cells(work: Workspace, marked: DataFrame) -> DataFrame:
    """Cells that hold a block of side 0 and one of side 1 of a mark (a, b)."""
    sizes = work.save(marked.groupBy("a", "b").agg(blocks(F.sum(1 - F.col("side")), CELL).alias("ni"), blocks(F.sum("side"), CELL).alias("nj")), "sizes")
    rows = marked.join(sizes, ["a", "b"])
    own = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumn("i", F.explode(F.when(F.col("side") == 0, own("ni")).otherwise(every("ni"))))
    rows = rows.withColumn("j", F.explode(F.when(F.col("side") == 1, own("nj")).otherwise(every("nj"))))
    return rows.select("a", "b", "i", "j", "side", "rep")


def candidate_stars(work: Workspace, shared: DataFrame) -> DataFrame:
    """(hub, rep): the hub of each bucket with every other representative in it."""
    weight = shared.groupBy("rep").agg(F.sum("c").alias("w"))
    hubs = shared.join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("top"))
    hubs = work.save(hubs.select("key", (-F.col("top.r")).alias("hub")), "hubs")
    return shared.join(hubs, "key").where("rep <> hub").select("hub", "rep").distinct()


def mixed_blocks(work: Workspace, shared: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several components: those outside the largest against all."""
    rows = work.save(shared.select("key", "rep").join(labels, "rep"), "labelled")
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    per_key = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    per_key = work.save(per_key.select("key", F.col("top.comp").alias("top"), blocks(F.col("all") - F.col("top.n"), BLOCK).alias("ni"), blocks(F.col("all"), BLOCK).alias("nj")), "per_key")
    rows = rows.join(per_key, "key")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = rows.where("comp <> top").withColumn("i", own("ni")).withColumn("j", every("nj")).withColumn("query", F.lit(1))
    all_ = rows.withColumn("i", every("ni")).withColumn("j", own("nj")).withColumn("query", F.lit(0))
    cols = ["key", "i", "j", "query", (F.col("comp") == F.col("top")).cast("int").alias("top"), "rep", "comp"]
    return ask.select(cols).union(all_.select(cols)).join(reps.select("rep", F.col("n_shingles").alias("n"), "sig"), "rep").select("key", "i", "j", "query", "top", "rep", "comp", "n", "sig")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``.  Links: similarity of ``percent`` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "minhash")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = work.save(source.mapInArrow(sketch, SKETCH), "sketches")

    named = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = work.save(named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    crowded = work.save(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowded")
    shared = work.save(banded.join(crowded, "key"), "shared")

    signed = reps.select("rep", "n_shingles", "sig")
    pairs = candidate_stars(work, shared).join(signed, "rep").join(signed.select(F.col("rep").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sig").alias("hub_sig")), "hub")
    pairs = work.save(pairs.where((100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n"))
                                  & (estimate(F.col("sig"), F.col("hub_sig")) >= percent / 100 - margin(percent))).select("hub", "rep"), "pairs")
    wanted = work.save(shared.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    texts = work.save(among(source, wanted, "doc_id").select(F.col("doc_id").alias("rep"), "text"), "texts")
    links = work.save(links_of(star_cells(work, pairs), texts, percent), "links")
    first = components(work, links, "x", "y")
    labels = work.save(shared.select("rep").distinct().join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp")), "labels")

    blocked = mixed_blocks(work, shared, labels, reps).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    marked = work.save(blocked.mapInArrow(lambda batches: marks(batches, percent), MARKS).distinct(), "marked")
    more = work.save(links_of(pair_cells(work, marked), texts, percent), "more")
    joined = more.join(labels.select(F.col("rep").alias("x"), F.col("comp").alias("cx")), "x").join(labels.select(F.col("rep").alias("y"), F.col("comp").alias("cy")), "y")
    second = components(work, joined, "cx", "cy")
    labels2 = labels.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("component_id"))

    member = work.save(reps.select("d1", "d2", "n_shingles", "rep").join(labels2, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component_id", "rep").alias("_class")), "member")
    # empty sets and rows without an id join with nothing
    nameless = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    rest = sketches.where(nameless).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = named.select("doc_id", "n_shingles", "d1", "d2").join(member, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", F.col("_class").alias("component_id"))
    out = work.save(found.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    work.drop_all_but(out)
    return out
