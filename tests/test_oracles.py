"""Every registered layout query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from quillframe import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    got = plans.queries()[name](spark, SF)
    want = db.sql(plans.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    right = sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert left == right
