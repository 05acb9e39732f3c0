"""Queries with SQL against it, at the smallest size."""

import os

import duckdb
import pytest

from evidspark.llm.oracles import ORACLES
from evidspark.llm.queries import queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    got = queries()[name](spark, data).toPandas()
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, want[order].astype(str).values))
