"""Every registered query of the engine against its DuckDB twin, and the entry module's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from glyphmine.plans.queries import QUERIES, SQL

from .compare import SF, same

#: Results that may be empty on the smallest tables.
MAY_BE_EMPTY = {"duplicate_keys", "outside_domain", "overrides", "catalog_problems", "search_fields", "search_strings"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_duckdb(spark, name):
    n = same(QUERIES[name](spark, SF), SQL[name])
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["source_id", "full_name", "kind", "relative_path", "start_line"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
