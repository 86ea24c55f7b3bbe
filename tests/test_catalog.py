"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, table_rows


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    frame = queries()[name](spark, small)
    got = table_rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == table_rows(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() == 5960
