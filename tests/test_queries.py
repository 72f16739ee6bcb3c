"""Every registered query against its SQL."""

import math

import duckdb
import pytest

from kindred import plans

TABLES = "customer supplier orders lineitem events documents embeddings"


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return round(float(value), 9) + 0.0
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, data, duck, name):
    found = plans.queries()[name](spark, data)
    rows = found.collect()
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.columns, rows) == bag(columns, want.fetchall())


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
