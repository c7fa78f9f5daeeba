"""Driver contract: entry(), queries(), oracle_sql(); a sample of oracle comparisons at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, rows_key  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["b5_clean_expenses", "c2_weighted", "c3_rule_confidence", "e8_category_insights", "f3_category_zscore",
          "g1_process_file", "a10_quick_list", "d2_tfidf_documents", "e1_overall", "b15_preset_ranges",
          "e12_data_quality", "d12_evaluate_rules", "e14_report_summary"]


def test_contract_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 80 and set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "percentage_of_total" in df.columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_key(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_key(dcols, res.fetchall())
