"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quire.plans import catalog

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(normal(x) for x in v)
    return v


@pytest.fixture(scope="module")
def views():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, views, name):
    got = catalog.QUERIES[name](spark, SF)
    want = views.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted(repr([normal(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([normal(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"k_wrap"}  # greedy; see test_annotations
