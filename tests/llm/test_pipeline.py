"""The pipeline against a plain run of its stages, and its parts' contract."""

import collections

import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm import decontam, minhash, packing
from test_operators import SF, brute_components, brute_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op") or n == "pipeline"] and all(any(x.startswith(f"op{k}_") for x in names) for k in range(1, 14))
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [decontam.normal(t) for _, t in duckdb.sql(f"select * from '{SF}/benchmark.parquet'").fetchall()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == COLUMNS
        got = {r.doc_id: r for r in after.collect()}
        if name == "language":  # all these documents hold letters in a known language
            assert got == rows
        elif name == "near_duplicates":
            want = brute_components([(d, r.text) for d, r in rows.items()], corpus_pipeline.PERCENT)
            assert got == {d: r for d, r in rows.items() if want[d][1] == d}
        elif name == "decontaminate":
            assert not any(x in decontam.normal(r.text) for r in got.values() for x in items)
            assert all(got[d] == rows[d] for d in got) and len(got) > 0.8 * len(rows)
        else:
            for d, r in rows.items():
                if not brute_secrets(r.text):  # no secret was planted here, so nothing is masked
                    assert got[d] == r
                else:
                    assert "[SECRET]" in got[d].text and got[d].n_chars == len(got[d].text)
        rows, docs = got, spark.createDataFrame(list(got.values()), docs.schema)
    packed = corpus_pipeline.run(spark, SF).collect()
    total = collections.Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == {d: len(r.text.split()) for d, r in rows.items()}


def test_odd_rows(spark):
    long = "der lange text und mehr " * 3000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "de", "s", 1), (3, long, "de", "s", 1), (None, "the words of one", "en", None, None), (None, "the words of one", "en", None, None),
            (4, "this is the password=abcdef123 of it", "en", "s", 5), (5, "the end of this", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name == "near_duplicates":
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3, 4, 5]
        if name == "secrets":
            assert {r.doc_id: r.text for r in docs.collect()}[4] == "this is the [SECRET] of it"
        if name != "pack":
            assert docs.columns[-1] == "score"
    assert docs.count() >= 5


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Unlike texts under one id stay, copies without an id go, the smallest id is kept."""
    words = [[f"w{k}_{j}" for j in range(60)] for k in range(6)]
    text = lambda k, edit=0: " ".join([f"e{edit}"] * (edit > 0) + words[k][edit > 0:])
    rows = [(1, text(0)), (1, text(1)), (1, text(1)), (None, text(2)), (None, text(2, 1)), (None, text(3)), (9, text(3, 2)), (8, text(3)), (7, None), (7, None), (6, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "x", 5) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _byid_page int")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert found[(None, text(2))] + found[(None, text(2, 1))] == 1
    assert found - collections.Counter({(None, text(2)): 1, (None, text(2, 1)): 1}) == collections.Counter([(1, text(0)), (1, text(1)), (8, text(3)), (7, None), (7, None), (6, "")])


def test_similarity_of_the_stage(spark):
    """Pairs between 0.80 and 0.85 are one group in the stage, and two in op4."""
    rng = [f"v{j}" for j in range(104)]
    edited = rng[:50] + ["edit"] + rng[51:98] + ["more"] + rng[99:]
    docs = spark.createDataFrame([(1, " ".join(rng)), (2, " ".join(edited))], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs).where("kept").count() == 2
    assert minhash.near_duplicates(docs, percent=80).where("kept").count() == 1


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, k):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.STAGES[k][1](spark, empty, SF).count() == 0


def test_parameters():
    assert minhash.PERCENT == 85 and minhash.SHINGLE == 5 and packing.BUCKETS > 1
