"""Every query of the catalogue against its SQL."""

import math
import os

import duckdb
import pytest

from hindsight import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value + 0.0 if isinstance(value, float) else value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    frame = QUERIES[name](spark, sf_dir)
    ours = table(frame.columns, [tuple(r) for r in frame.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    found = con.sql(SQL[name])
    assert ours == table(found.columns, found.fetchall())
