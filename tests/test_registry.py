"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ("flagship", "p", "w4", "w11", "a1_", "a4", "q2", "j1_", "k1", "e9", "g11", "u4")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith(FAST)])
def test_query_equals_sql(spark, con, name):
    from check import canonical

    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert canonical(got).equals(canonical(want))
