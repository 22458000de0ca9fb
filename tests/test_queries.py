import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def check(spark, query, sql):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f[:-8]} as from '{DATA}/{f}'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, queries.queries()[name], oracles.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and any(r.action == "KEEP" for r in rows)
