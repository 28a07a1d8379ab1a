"""The queries of the subpackage against their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, registry
from tests.test_queries import plain

DATA = os.environ.get("SQL_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def same(df, cursor):
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    same(registry.queries()[name](spark, DATA), duck.execute(registry.oracle_sql()[name]))


def test_shuffled_decontamination(spark, duck):
    out = decontaminate.contamination(registry.documents(spark, DATA), spark.read.parquet(f"{DATA}/benchmark.parquet"), broadcast_bytes=0)
    out = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
    same(out, duck.execute(decontaminate.ORACLE))
