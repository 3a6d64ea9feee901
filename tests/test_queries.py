"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import registry

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rounded(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want
