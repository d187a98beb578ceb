"""Every registered query against its SQL on the given tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows(names, records):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in places], sorted(tuple(plain(r[i]) for i in places) for r in records)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    result = duck.execute(contract.oracle_sql()[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
    assert got[1]


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
