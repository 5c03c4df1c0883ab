"""Every query against its SQL on the smallest data set."""

import math
from pathlib import Path

import duckdb
import pytest

from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.oracle import SQL

FOLDER = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    columns = sorted(frame.columns)
    listed = [tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(listed, key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, str(FOLDER)).toPandas()
    assert rows(found) == rows(duck.execute(SQL[name]).df())
