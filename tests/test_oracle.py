"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = canonical([tuple(r) for r in result.collect()], result.columns)
    assert got and got == canonical(expected.fetchall(), columns)


def test_queries_without_sql(spark, sf_dir):
    assert {q for q in set(QUERIES) - set(ORACLE) if q.startswith("q_")} == set()


def test_entry(spark):
    assert not registry.entry(spark).isEmpty()
