"""Hard negatives by slot-decomposed selection.

For every anchor and each of its positives, the hard negatives are the best rows of another label
whose score lies in a window of the positive's score (LOW to HIGH percent).  The windows of an
anchor overlap, so they are not searched one by one: the upper limits of its positives cut the
scores into disjoint slots, every task keeps the best ``negatives`` rows per slot while it reads its
rows, and the merged slots answer all windows: a window holds what its own slot and all lower ones
keep, in descending order, down to the window's lower limit.

A score is the inner product of whole numbers.  Anchors are read in blocks of at most about
BLOCK_VALUES numbers; a block is broadcast, meets every row where that row lies, and is released when
its results are written.  No row is shuffled: only the best rows per task, anchor and slot are.  The
number of blocks grows with the anchors, no block and no task does.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no
part; a vector shorter than others counts as followed by zeros; ties go to the smaller id; repeated
rows take part once each, but never as positives of an anchor with their own id; repeated anchors
have one set of rows each; an anchor without positives, or a positive without rows in its window,
yields nothing; an empty table gives an empty table; scores are exact up to 64 bits and stay at that
limit beyond; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm.arrow import shared
from tallyspark.llm.best import LEAST, MOST, Best
from tallyspark.llm.work import Workspace

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
BLOCK_VALUES = 1 << 21
TILE = 1 << 20
FOUND = "q bigint, slot int, score bigint, id bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, values) of the rows that take part; a component x becomes floor(scale * x)."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, real)
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                                       F.transform(vector, lambda x: F.floor(x * scale).cast("bigint")).alias("values"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of whole numbers, the shorter ones followed by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide)[None, :] < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and x."""
    n = min(a.shape[1], x.shape[1])
    a, x = a[:, :n], x[:, :n]
    bound = n * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0))
    if bound < 1 << 53:
        return (a.astype(float) @ x.astype(float).T).astype(np.int64)
    if bound < 1 << 62:
        return a @ x.T
    return np.clip(a.astype(object) @ x.astype(object).T, LEAST, MOST).astype(np.int64)


class Block:
    """Anchors with their slots: the upper limits of an anchor's slots fall, LEAST - 1 where there is none."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.q, self.ids, self.labels, self.values = q, ids, labels, values
        self.upper, self.lowest = np.full((len(q), 1), MOST), np.full(len(q), LEAST)

    def scan(self, batches: Iterator[pa.RecordBatch], k: int, same: bool) -> Iterator[pa.RecordBatch]:
        """The best k rows per anchor and slot among the rows of the same, or of another label."""
        n, slots = self.upper.shape
        best = Best(n * slots, k)
        step = max(1, TILE // n)
        for batch in batches:
            ids, labels, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            for at in range(0, len(ids), step):
                score = products(self.values, values[at:at + step])
                fits = (self.labels[:, None] == labels[None, at:at + step]) == same
                if same:
                    fits &= self.ids[:, None] != ids[None, at:at + step]
                slot = np.full(score.shape, -1, np.int64)
                for j in range(slots):
                    slot += score <= self.upper[:, j][:, None]
                fits &= (slot >= 0) & (score >= self.lowest[:, None])
                fits &= score >= best.floor.reshape(n, slots)[np.arange(n)[:, None], np.maximum(slot, 0)]
                row, col = np.nonzero(fits)
                if len(row):
                    best.add(row * slots + slot[row, col], score[row, col], ids[at + col])
        group = np.repeat(np.arange(n * slots), best.filled)
        place = np.arange(k)[None, :] < best.filled[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(self.q[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(best.score[place]), pa.array(best.id[place])], ["q", "slot", "score", "id"])

    def cut(self, positives: pa.Table, low: int, high: int) -> pa.Table:
        """Set the slots from the positives (q, id, score); those get their slot and lower limit."""
        at = np.searchsorted(self.q, positives.column("q").to_numpy())
        scores = positives.column("score").to_pylist()
        upper = [high * s // 100 for s in scores]
        lower = [-(-low * s // 100) for s in scores]
        limits = [sorted({u for u in us}, reverse=True) for us in grouped(at, upper, len(self.q))]
        self.upper = np.full((len(self.q), max(map(len, limits), default=0) or 1), LEAST - 1)
        for k, us in enumerate(limits):
            self.upper[k, :len(us)] = us
        self.lowest = np.array([min(x, default=MOST) for x in grouped(at, lower, len(self.q))], np.int64)
        slot = [limits[k].index(u) for k, u in zip(at.tolist(), upper, strict=True)]
        return positives.append_column("slot", pa.array(slot, pa.int32())).append_column("lower", pa.array(lower, pa.int64()))


def grouped(at: np.ndarray, values: list[int], n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for k, v in zip(at.tolist(), values, strict=True):
        out[k].append(v)
    return out


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (id, label, values)."""
    spark = rows.sparkSession
    work = Workspace(spark, "negatives")
    rows = work.save(rows, "rows")
    anchors = work.save(rows.where(is_anchor).withColumn("q", F.monotonically_increasing_id()), "anchors")
    blocks = -(-(anchors.agg(F.sum(F.size("values") + 1)).first()[0] or 0) // BLOCK_VALUES)
    out, kept = spark.createDataFrame([], RESULT), []
    for k in range(blocks):
        part = anchors.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).toArrow().sort_by("q")
        if not part.num_rows:
            continue
        block = Block(*(part.column(c).to_numpy() for c in ("q", "id", "label")), matrix(part.column("values")))

        def search(k: int, same: bool, block: Block = block) -> DataFrame:
            with shared(spark, block) as given:
                return work.save(rows.mapInArrow(lambda batches: given().scan(batches, k, same), FOUND), "best")

        chosen = best_of(search(positives, True), positives).select("q", "id", "score").toArrow()  # ``positives`` rows per anchor of the block
        asked = spark.createDataFrame(block.cut(chosen, low, high))
        slots = best_of(search(negatives, False), negatives)
        # all slots of an anchor, best first: at most ``negatives`` rows per positive
        merged = slots.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("id").alias("negative_id"), "slot", F.col("score").alias("negative_score")))).alias("merged"))
        window = F.slice(F.filter("merged", lambda x: (x["slot"] >= F.col("slot")) & (x["negative_score"] >= F.col("lower"))), 1, negatives)
        names = spark.createDataFrame(part.select(["q", "id"]).rename_columns(["q", "anchor_id"]))
        rank = asked.join(merged, "q").join(names, "q").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("at", "found"))
        kept.append(work.save(rank.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "found.negative_id", "positive_score", "found.negative_score"), "mined"))
        out = out.unionByName(kept[-1])
        work.drop_all_but(rows, anchors, *kept)
    work.drop_all_but(*kept)
    return out


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The query: labels of ids divisible by 7 are moved on by one first; anchors are ids divisible by 50."""
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(whole_numbers(moved), F.col("id") % 50 == 0)


ORACLE = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES}),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
