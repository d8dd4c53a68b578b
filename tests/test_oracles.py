"""Every registered query against its SQL, over the whole small tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import ORACLES, QUERIES

spec = importlib.util.spec_from_file_location(
    "check_oracles", Path(__file__).resolve().parents[1] / "tools" / "check_oracles.py"
)
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
