"""Every registered query against its SQL in DuckDB on the smallest data set."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from lakewarden.operators import profiling
from lakewarden.sources.readers import lake

ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    outcome, _ = compare(spark, con, ROOT, name, entry.queries()[name], SQL.get(name))
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_entry(spark):
    df = entry.entry(spark)
    profiled = [c for t in lake(spark, ROOT).values() for c in profiling.profiled_fields(t)]
    assert df.count() == len(profiled)
    assert "classification" in df.columns


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
