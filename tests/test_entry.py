"""Queries against their SQL over the smallest tables, where these are at hand."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidelog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_every_query_is_registered():
    names = set(entry_module.queries())
    assert set(catalogue.queries()) <= names
    assert set(entry_module.oracle_sql()) <= names
