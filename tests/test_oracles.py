"""Every registered query against DuckDB on the small tables."""

import os

import duckdb
import pytest

from tarnflow.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(want.fetchall(), key=key) and got
