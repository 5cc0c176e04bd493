"""Every query with SQL gives the SQL's rows on the small tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as spark_entry

#: The queries of the optional subpackage have tests of their own beside it.
QUERIES = {
    name: query
    for name, query in spark_entry.queries().items()
    if name != "pipeline" and not name.startswith("op")
}
ORACLE = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 173


def test_all_have_sql():
    assert set(ORACLE) >= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    result = tables.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(map(str, result.fetchall()))
    assert sorted(str(tuple(row)) for row in df.select(*names).collect()) == expected
