"""Every catalogued query with SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from feedweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def tidy(rows):
    number = lambda x: round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted(repr(tuple(number(x) for x in r)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert tidy(got.select(*columns).collect()) == tidy(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@needs_data
def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
