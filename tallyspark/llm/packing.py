"""Length buckets for training batches.

Texts are counted in words (runs of characters other than blank and \\x09-\\x0D); a text of more
than MAX_LENGTH words becomes several pieces, each but the last of MAX_LENGTH words.  From the
histogram of all piece lengths, at most MAX_LENGTH bins, a dynamic program chooses BUCKETS bucket
boundaries with the least padding overall (ties: the smaller boundary).  Inside a bucket, pieces in
order of a hash of their id fill batches of floor(TOKEN_BUDGET / boundary) pieces, so that only the
last batch of a bucket may be short.

Places in a bucket come from one range-partitioned sort by bucket, hash, id, piece, length and a written row
number: a row's place is its position in its partition plus the sizes of the partitions before it.  Since
the row number is part of the key, no bucket, id or group of rows without an id passes through one task.

Defined results: null and wordless texts give one row with length 0 and no bucket, batch or slot;
rows without an id share the hash of an empty id; repeated rows take places of their own; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import once
from tallyspark.llm.work import Workspace
from tallyspark.operators.order import global_rank

MAX_LENGTH = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least total padding.

    Exact: cost[j] of the best cut of the first j lengths, once for every number of buckets.  Padding
    of lengths i+1..j is boundary j times their number less their sum.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)])
    words = np.concatenate([[0], np.cumsum(counts * lengths)])
    never = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, never)
    best[0] = 0
    came = []
    for _ in range(min(buckets, n)):
        new, source = np.full(n + 1, never), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (words[j] - words[:j])
            source[j] = cost.argmin()
            new[j] = min(cost[source[j]], never)
        came.append(source)
        best = new
    ends, j = [], n
    for source in reversed(came):
        ends.append(int(lengths[j - 1]))
        j = int(source[j])
    return ends[::-1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, piece, start, length): word ranges of at most ``max_length`` words that cover each text."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    counted = once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), _n=n).select("doc_id", "_n")
    last = F.greatest(F.ceil(F.col("_n") / max_length) - 1, F.lit(0)).cast("long")
    cut = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(max_length)).alias("length"))


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, piece, start, length, bucket, batch, slot, padding; one row per piece."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.save(pieces(docs, max_length=max_length), "pieces")
    histogram = cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).toPandas()  # max_length rows at most
    ends = boundaries(histogram["length"].to_numpy(), histogram["n"].to_numpy(), buckets)
    if not ends:
        none = lambda kind: F.lit(None).cast(kind)
        return cut.select("*", none("long").alias("bucket"), none("long").alias("batch"), none("long").alias("slot"), F.when(F.lit(False), 0).cast("long").alias("padding"))
    bucket = F.coalesce(*[F.when(F.col("length") <= e, F.lit(e)) for e in ends]).cast("long")
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    full = cut.where("length > 0").select("*", bucket.alias("bucket"), key.alias("_key"), F.monotonically_increasing_id().alias("_row"))
    placed = global_rank(full, ["bucket", "_key", "doc_id", "piece", "length", "_row"], "_place")
    sizes = [int(histogram["n"][(histogram["length"] <= e) & (histogram["length"] > before)].sum()) for before, e in zip([0, *ends[:-1]], ends, strict=True)]
    first = F.coalesce(*[F.when(F.col("bucket") == e, F.lit(sum(sizes[:k]))) for k, e in enumerate(ends)])
    room = F.greatest(F.floor(F.lit(token_budget) / F.col("bucket")), F.lit(1)).cast("long")
    at = F.col("_place") - first
    placed = placed.select("doc_id", "piece", "start", "length", "bucket", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"), (F.col("bucket") - F.col("length")).alias("padding"))
    empty = cut.where("length = 0").select("doc_id", "piece", "start", "length", *[F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot", "padding")])
    return placed.unionByName(empty)


def oracle(max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> str:
    """DuckDB twin: the same dynamic program as one step of SQL for every number of buckets."""
    layers = ["l0 as (select 0 as j, 0::bigint as cost, 0 as src)"]
    for k in range(1, buckets + 1):
        layers.append(f"""l{k} as (
  select j, best.cost as cost, best.src as src from (select s.j, min({{'cost': p.cost + s.len * (s.rows - coalesce(q.rows, 0)) - (s.words - coalesce(q.words, 0)), 'src': p.j}}) as best
  from s join l{k - 1} p on p.j < s.j left join s q on q.j = p.j group by s.j))""")
    # walk back from the last length; fewer distinct lengths than buckets use as many layers as lengths
    back = [f"b{buckets} as (select m as j from top)"]
    for k in range(buckets, 1, -1):
        back.append(f"b{k - 1} as (select case when {k} > top.used then b{k}.j else l{k}.src end as j from b{k} cross join top left join l{k} on l{k}.j = b{k}.j)")
    ends = " union ".join(f"select j from b{k}" for k in range(1, buckets + 1))
    return rf"""
with w as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n from documents),
c as (select doc_id, n, unnest(range(greatest(((n + {max_length - 1}) // {max_length}), 1))) as piece from w),
p as (select doc_id, piece, piece * {max_length} as start, least(n - piece * {max_length}, {max_length}) as length from c),
h as (select length as len, count(*)::bigint as n from p where length > 0 group by length),
s as materialized (select row_number() over (order by len) as j, len, (sum(n) over (order by len))::bigint as rows, (sum(n * len) over (order by len))::bigint as words from h),
top as (select max(j) as m, least(max(j), {buckets}) as used from s),
{", ".join(x.replace(" as (", " as materialized (", 1) for x in layers)},
{", ".join(back)},
e as (select distinct len as bucket from s where j in ({ends})),
f as (select p.*, (select min(bucket) from e where bucket >= p.length) as bucket, md5(doc_id || ':' || piece) as key from p where length > 0),
r as (select *, row_number() over (partition by bucket order by key, doc_id, piece, length) - 1 as place, greatest({token_budget} // bucket, 1) as room from f)
select doc_id, piece, start, length, bucket, place // room as batch, place % room as slot, bucket - length as padding from r
union all select doc_id, piece, start, length, null, null, null, null from p where length = 0"""
