"""All queries over the driver tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import fixture_queries, given_queries, graph_queries, model_queries, table_queries, text_queries, written_queries

#: Of queries with one name the last counts: those over written tables take the place of those over a few rows, which the tests still run.
_MODULES = (fixture_queries, text_queries, table_queries, model_queries, written_queries, graph_queries, given_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
