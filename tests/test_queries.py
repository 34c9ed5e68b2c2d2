"""Every query with an SQL twin gives the same rows on the small tables; entry() runs."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skonto import queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_twin(spark, sql, name):
    df = Q.QUERIES[name](spark, FOLDER)
    cur = sql.execute(Q.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
