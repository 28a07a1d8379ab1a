"""Every query of the library against its SQL on the smallest tables; the contract of the entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quire.plans import catalogue, fixture_queries, text_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def small_queries():
    """Queries over a few rows of our own that others of their name took the place of."""
    all_ = {f.__name__: (f, m.ORACLES[f.__name__]) for m in (fixture_queries, text_queries) for f in m.QUERIES if f.__name__ in m.ORACLES}
    return {f"{n} of a few rows": x for n, x in all_.items() if x[0] is not catalogue.queries()[n]}


ALL = {n: (f, catalogue.oracle_sql().get(n)) for n, f in catalogue.queries().items()} | small_queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    query, sql = ALL[name]
    df = query(spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if sql:
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(cursor.fetchall(), columns)
    else:
        assert rows


def test_chunks_keep_within_the_budget(spark):
    assert all(r["longest"] <= 150 for r in catalogue.queries()["chunk_bytes"](spark, DATA).collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
