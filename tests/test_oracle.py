"""Every query against its SQL over the smallest data set."""

import duckdb
import pytest

from conftest import TESTDATA
from __spark_entry__ import entry
from oracle.sql import oracle_queries as oracle_sql
from shiftgauge.queries import queries

SF_DIR = TESTDATA / "sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda t: [(x is not None, str(x)) for x in t])


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    got = queries()[name](spark, str(SF_DIR))
    expected = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    types = {d[0]: str(d[1]) for d in expected.description}
    assert sorted(got.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == types
    assert sorted_rows(got.collect(), got.columns) == sorted_rows(expected.fetchall(), columns)


def test_scores_stay_in_range(spark):
    report = entry(spark)
    scores = [
        "framework_coupling", "database_coupling", "dependency_compatibility", "architecture", "test_coverage",
        "codebase_size", "total",
    ]
    assert report.count() > 0
    assert report.filter(" or ".join(f"not {s} between 0 and 100" for s in scores)).count() == 0
