"""Every registered query against its SQL, by name, type and value."""

import duckdb
import pytest

import __spark_entry__ as contract
from punctual.catalog import QUERIES as CATALOG

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}
SQL = contract.oracle_sql()
QUERIES = {name: query for name, query in contract.queries().items() if name in CATALOG}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in places) for row in rows), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(CATALOG) and set(CATALOG) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(name, spark, sf_dir, duck):
    ours, theirs = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert {c: TYPES[t] for c, t in ours.dtypes} == {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    assert ordered(ours.columns, ours.collect()) == ordered(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql_without_broadcasts(name, spark, sf_dir, duck):
    """The joins that large tables take."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ours, theirs = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
        assert ordered(ours.columns, ours.collect()) == ordered(theirs.columns, theirs.fetchall())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() == 1
