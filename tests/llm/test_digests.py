import os

import duckdb
import pytest

from tessera.llm.digests import ORACLE_SQL, QUERIES

from .conftest import DATA, needs_data


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))
