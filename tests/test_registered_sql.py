"""Every registered query of the catalogue beside its SQL on the smallest tables: columns, rows and values."""

import math

import duckdb
import pytest

from tidemark.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return str(value) if value is not None and not isinstance(value, (int, bool)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_and_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    relation = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(relation.columns)
    columns = sorted(got.columns)
    want = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    rows = [tuple(map(comparable, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    assert len(rows) == len(want)
    assert sorted(rows, key=str) == sorted((tuple(map(comparable, r)) for r in want), key=str)
