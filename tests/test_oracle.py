"""Every registered query against its SQL oracle (DuckDB) on the smallest data."""

import os

import pytest

import __spark_entry__ as E
from qaframe.plans.catalog import QUERIES
from tools.check_oracle import duck, norm_rows

SF = os.environ.get("QAFRAME_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# compared with the public tokenizer library in test_bpe_logs_sinks.py, with the exact search in test_search.py
ELSEWHERE = {"nfkc_texts", "bpe_merges", "encode_texts", "padded_encoded_batches", "vocab_specials",
             "bpe_length_stats", "search_ann"}


def test_every_query_is_compared():
    assert set(QUERIES) - set(SQL) == ELSEWHERE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ELSEWHERE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert norm_rows(df.columns, rows) == norm_rows(dcols, cur.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
