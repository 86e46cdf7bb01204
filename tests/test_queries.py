"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from kinfold import catalog

from compare import cells, oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), oracle(catalog.ORACLE_SQL[name], FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and any(r["cands"] for r in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
