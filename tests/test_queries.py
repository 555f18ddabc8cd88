"""Every registered query against the same query in another engine."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as registered

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, SQL = registered.queries(), registered.oracle_sql()
SPARK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def other(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, other, name):
    result = QUERIES[name](spark, data)
    columns = sorted(result.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in result.collect())
    if name not in SQL:
        assert got
        return
    cursor = other.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
    types = {r[0]: r[1] for r in other.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: SPARK_TYPES.get(t, t) for c, t in result.dtypes} == types


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert len(rows) == 5 and rows[0].risk_score >= rows[-1].risk_score > 0
