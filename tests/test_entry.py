import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_every_query_is_callable():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["agg_group", "join_multi", "preload_nested", "upsert_accumulate", "cte_recursive", "tx_savepoint"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))
