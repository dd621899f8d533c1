"""Every registered query against its SQL on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def database():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def test_every_sql_has_its_query():
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    result = contract.queries()[name](spark, SF_DIR)
    rows = [tuple(row) for row in result.collect()]
    wanted = database.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in wanted.description]
    expected = wanted.fetchall()
    assert sorted(result.columns) == sorted(columns)
    assert rows, "the query gives no rows"
    assert comparable(rows, result.columns) == comparable(expected, columns)
