"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def one(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) + 0.0 if isinstance(v, float | decimal.Decimal) else str(v)

    return sorted(columns), sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        assert _canonical(df.columns, rows) == _canonical([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
