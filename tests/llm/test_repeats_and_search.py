"""Substring dedup, hard negatives and ranked search against SQL twins and plain Python."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from tallyspark.llm import lexical, negatives, substrings
from tallyspark.llm.best import Best
from tallyspark.llm.work import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def twin(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return collections.Counter(con.execute(sql).fetchall())


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# ---- substring dedup


def brute_repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept_sha256) with a dictionary of all windows."""
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    order = [d if d is not None else math.inf for d, _ in rows]
    for ws, d in zip(words, order, strict=True):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            least[key] = min(least.get(key, math.inf), d)
    out = []
    for (doc, _), ws, d in zip(rows, words, order, strict=True):
        gone = set()
        for k in range(len(ws) - window + 1):
            if least[tuple(ws[k:k + window])] < d:
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return collections.Counter(out)


def woven(rng, n=60):
    """Documents that share passages, lines, copies and repeats inside themselves."""
    vocab = [f"w{k}" for k in range(40)] + ["É", "naïve", "x" * 200]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 60))] for _ in range(8)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((rng.choice([d, d, d, 3, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100 + k, rows[5][1]) for k in range(5)] + [(None, rows[7][1])] * 2 + [(2, rows[9][1])] * 2
    return rows


ODD = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (5, " ".join(f"u{k}" for k in range(13))), (4, " ".join(f"u{k}" for k in range(14))), (None, " ".join(f"u{k}" for k in range(1, 14))),
       (6, "z " * 500), (7, "z " * 300), (7, "z " * 300), (8, " ".join(f"v{k % 977}" for k in range(30_000))), (9, " ".join(f"v{k % 977}" for k in range(5, 30_000)))]


def test_repeats_match_sql(spark):
    got = substrings.remove_repeats(read(spark, "documents")).drop("spans")
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert rows_of(got) == twin(substrings.ORACLE, "documents")


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, seed):
    rows = woven(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert rows_of(substrings.remove_repeats(df).drop("spans")) == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id bigint, text string, rid string, k1 int")
    assert rows_of(substrings.remove_repeats(df).drop("spans")) == brute_repeats(ODD)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_repeats_survive_false_paths(spark, monkeypatch):
    """With fingerprints that always agree every path is too long; coordinates show it."""
    rows = woven(random.Random(3))
    monkeypatch.setattr(substrings, "fingerprint", lambda place: place * 0)
    assert rows_of(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("spans")) == brute_repeats(rows)


def test_repeats_spans_name_their_source(spark):
    rows = woven(random.Random(4))
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(WORD.findall(t))
    found = [(r, s) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() for s in r.spans]
    assert found
    for r, s in found:
        size = s.end - s.start
        mine = [ws[s.start:s.end] for ws in texts[r.doc_id] if len(ws) == r.n_words]
        assert size >= 13 and any(m == ws[s.source_start:s.source_start + size] for m in mine for ws in texts[s.source_id])


def test_paths_are_compact(spark):
    """A passage that two documents share is one path, whatever its length."""
    rng = random.Random(5)
    shared = [f"s{k}" for k in range(400)]
    rows = [(d, " ".join([f"a{d}_{k}" for k in range(rng.randint(1, 40))] + shared + [f"b{d}"])) for d in range(6)]
    spans = [r.spans for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert spans[0] == [] and all(len(s) == 1 and s[0].end - s[0].start == 400 and s[0].source_id == 0 for s in spans[1:])


# ---- hard negatives


def brute_negatives(rows):
    """The contract, word for word; rows as (vec_id, embedding, label)."""
    sound = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in e])
             for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, lab, v in {(i, lab, tuple(e)): (i, lab, e) for i, lab, e in sound if i % 50 == 0}.values():
        score = [(sum(x * y for x, y in zip(v, e, strict=False)), i, other) for i, other, e in sound]
        for p, i, _ in sorted((x for x in score if x[2] == lab and x[1] != a), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted((x for x in score if x[2] != lab and 50 * p <= 100 * x[0] <= 95 * p), key=lambda x: (-x[0], x[1]))[:3]
            out += [(a, i, k + 1, n, p, s) for k, (s, n, _) in enumerate(fit)]
    return collections.Counter(out)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_negatives_match_sql(spark):
    got = negatives.hard_negatives(read(spark, "embeddings"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert rows_of(got) == twin(negatives.ORACLE, "embeddings")


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_match_brute_force(spark, seed, monkeypatch):
    """Ties, repeated vectors, several blocks and tiles, odd rows."""
    rng = random.Random(seed)
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 12)
    monkeypatch.setattr(negatives, "TILE", 40)
    rows = [(k, [rng.choice([0.0, 0.25, 0.5, 1.0, -0.25]) for _ in range(3)], rng.choice([0, 0, 0, 1, 2, 9])) for k in range(400)]
    rows += [(401, None, 1), (402, [0.5, None, 0.1], 1), (403, [float("nan")] * 3, 2), (404, [float("inf"), 0.0, 0.0], 0), (405, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (406, [], 1), (407, [1.0], 0), (450, [1.0, 1.0], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", q string").repartition(5)
    assert rows_of(negatives.hard_negatives(df)) == brute_negatives(rows)


def test_negatives_large_numbers(spark):
    rng = random.Random(3)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * 1e5)) for _ in range(4)], k % 3) for k in range(120)]
    assert rows_of(negatives.hard_negatives(spark.createDataFrame(rows, VECTORS))) == brute_negatives(rows)
    assert negatives.products(np.array([[1 << 40, 3]]), np.array([[1 << 15, 1]])).tolist() == [[(1 << 55) + 3]]
    assert negatives.products(np.array([[1 << 62]]), np.array([[1 << 62]])).tolist() == [[(1 << 63) - 1]]


def test_negatives_empty(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], VECTORS)).count() == 0


def test_best_matches_sorting():
    rng = np.random.default_rng(1)
    best, every = Best(4, 3), []
    for _ in range(30):
        group, score, ids = rng.integers(0, 4, 20), rng.integers(-3, 4, 20), rng.integers(0, 50, 20)
        best.add(group, score, ids)
        every += zip(group.tolist(), score.tolist(), ids.tolist(), strict=True)
    for g in range(4):
        want = sorted(((s, i) for x, s, i in every if x == g), key=lambda p: (-p[0], p[1]))[:3]
        assert list(zip(best.score[g].tolist(), best.id[g].tolist(), strict=True)) == want and best.floor[g] == want[-1][0]


# ---- ranked lexical search


def brute_search(docs, items, top=20):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: TERM.findall((t or "").translate(fold))
    held = [(d, collections.Counter(ts), len(ts)) for d, t in docs if (ts := terms(t))]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = collections.Counter(terms(text))
        found = []
        for d, c, n in held:
            m = 75 + 25 * n * n_docs // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            found.append((-score, math.inf if d is None else d, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(x for x in found if x[0] < 0)[:top])]
    return collections.Counter(out)


def test_search_matches_sql(spark):
    got = lexical.ranked_search(read(spark, "documents"), read(spark, "benchmark"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == twin(lexical.ORACLE, "documents", "benchmark")


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search_matches_brute_force(spark, seed, monkeypatch):
    """Small cells, blocks and chunks; ties, repeated rows, odd texts."""
    monkeypatch.setattr(lexical, "CELL_POSTINGS", 50)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    monkeypatch.setattr(lexical, "PAIRS", 64)
    rng = random.Random(seed)
    vocab = ["the", "The", "x9", "É", "é", "naïve", "a_b", "don't", "日本", "\x7fq"] + [f"t{k}" for k in range(30)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab[:rng.choice([4, 40])]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 12, 12, 60]))) for k in range(150)]
    docs += [(200 + k, docs[9][1]) for k in range(30)] + [(7, docs[9][1])] * 3 + [(None, docs[10][1]), (301, None), (302, "- !"), (303, "the " * 3000)]
    items = [(k, text(rng.randint(0, 30))) for k in range(12)] + [(3, "the é"), (None, "t1 t2 t2"), (50, None), (51, "unknown"), (52, docs[9][1])]
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, terms string")
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, m int").repartition(6)
    assert rows_of(lexical.ranked_search(df, asked)) == brute_search(docs, items)


def test_search_leaves_out_what_cannot_enter(spark, monkeypatch):
    """Cells under an item's 20th best score are not scored, and the result is the same."""
    docs = [(k, "rare " + "word " * (k % 7)) for k in range(40)] + [(100 + k, "word " + "other " * (40 + k)) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    work = Workspace(spark, "test")
    index = lexical.build_index(work, df)
    table = index.cells.toArrow()
    items = [(1, "rare word")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(lexical.search(work, index, asked)) == brute_search(docs, items)
    counted = next(iter(lexical.count_terms(iter(asked.toArrow().to_batches()))))
    block = lexical.Items(lexical.pa.table({"q": [0], "terms": counted.column("terms"), "tfs": counted.column("tfs")}))
    block.weight[:] = 5000
    scored = []
    monkeypatch.setattr(lexical.Best, "add", lambda self, *a, add=Best.add: (scored.append(len(a[0])), add(self, *a)))
    list(block.search(iter(table.combine_chunks().to_batches()), 20))
    assert sum(scored) < len(docs) / 2


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.ranked_search(none, items).count() == 0
    assert lexical.ranked_search(none.withColumnRenamed("doc_id", "x").selectExpr("x as doc_id", "text"), items.limit(0)).count() == 0
