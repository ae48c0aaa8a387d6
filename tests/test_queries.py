"""Every query against its SQL on the smallest tables."""

import os

import pytest

from textloom.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t[:-8]} as select * from '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows = QUERIES[name](spark, DIR)
    got = sorted(map(str, (tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect())))
    if name in SQL:
        found = con.execute(SQL[name])
        names = [c[0] for c in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(rows.columns)
        assert got == sorted(str(tuple(r[i] for i in order)) for r in found.fetchall())
    else:
        assert got or name == "custom_entities"
