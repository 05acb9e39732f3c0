"""Every registered query of the package against its DuckDB SQL, or for rows and a stable schema where it has none."""

import os

import duckdb
import pandas as pd
import pytest

from evidspark.plans import document_queries, retrieval_queries

QUERIES = retrieval_queries.QUERIES | document_queries.QUERIES
SQL = retrieval_queries.SQL | document_queries.SQL


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, float):
        return f"{x:.6g}"
    if type(x).__name__ in ("Timestamp", "date", "datetime64"):
        return str(pd.Timestamp(x))
    if type(x).__name__ in ("list", "ndarray", "tuple"):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x) if not type(x).__name__.startswith("int") else f"{float(x):.17g}"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    number = lambda x: float(x) if type(x).__name__.startswith("int") else x
    return sorted(tuple(plain(number(x)) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    assert frame.columns
    assert frame.columns == QUERIES[name](spark, data).columns
    assert frame.count() == len(frame.collect())
