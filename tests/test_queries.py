"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        assert columns
        return
    cursor = database.execute(CHECKS[name])
    wanted_columns, wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert columns == wanted_columns
    assert rows == wanted


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 150
