"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pairloom.plans.catalog import QUERIES
from pairloom.plans.oracles import ORACLES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def canonical(rows):
    def value(v):
        return round(v, 9) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in row) for row in rows), key=str)


def test_registration():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = frame.select(*columns).collect()
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    wanted = [dict(zip(described, row)) for row in cursor.fetchall()]
    assert sorted(described) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in frame.schema} == described
    assert canonical(found) == canonical([row[c] for c in columns] for row in wanted)


def test_entry(spark):
    row = entry(spark).collect()
    assert len(row) == 1 and row[0]["total_samples"] > 0
