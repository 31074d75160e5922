"""Registered queries of the engine against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from basalt import queries, surface  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == columns
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert plain(tuple(r[i] for i in place) for r in want.fetchall()) == plain(tuple(r[c] for c in columns) for r in frame.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
