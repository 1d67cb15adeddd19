"""Every query that SQL can express, held against DuckDB; all of them give a stable schema."""

import pytest

import __spark_entry__ as entry
from tradeweave.plans.registry import ORACLES, QUERIES

from .oracle import SMALL, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
