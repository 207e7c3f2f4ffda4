"""Driver contract: entry() runs; every registered query runs on sf0.001 and,
where an oracle exists, matches it (rows, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from weft.sources.tables import TABLES
from tests.conftest import SF001


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def test_every_oracle_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    duck = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema.fields:                      # same types, not only same names
        assert TYPES.get(f.dataType.simpleString()) == duck[f.name], (f.name, f.dataType, duck[f.name])
    assert _rows(df.columns, rows) == _rows(rel.columns, rel.fetchall())
