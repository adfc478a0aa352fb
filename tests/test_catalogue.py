"""Every registered query of the engine against its SQL, on the small tables."""

import os

import duckdb
import pytest

from parcelforge import queries

NAMES = list(queries.QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(value)
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name not in queries.SQL:
        assert rows
        return
    cursor = duck.execute(queries.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert rows == want


def test_every_query_but_the_sequential_has_sql():
    assert set(NAMES) - set(queries.SQL) == {"fuzzy_best", "reading_order", "anchor_fields", "sample_files"}
