"""Every registered query against its DuckDB counterpart, on whole tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(columns, names, data):
    at = [names.index(c) for c in columns]
    return sorted(([plain(r[i]) for i in at] for r in data), key=lambda r: [(v is None, str(v)) for v in r])


# The queries of the optional part have their own tests.
OPTIONAL = {*entry.corpus.QUERIES, "pipeline"} if entry.corpus else set()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - OPTIONAL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"))
    assert "Pandas" not in plan
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert rows(columns, df.columns, df.collect()) == rows(columns, names, cursor.fetchall())


def test_every_query_has_a_counterpart():
    assert set(entry.queries()) - OPTIONAL == set(entry.oracle_sql()) - OPTIONAL


def test_entry(spark):
    assert entry.entry(spark).count() > 0
