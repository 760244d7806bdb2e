"""Queries with SQL agree with DuckDB on the smallest given tables."""

import pytest

from martlib.llm.queries import ORACLE, QUERIES

from oracle_check import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_sql(spark, key):
    assert differences(spark, connect(SF_DIR), SF_DIR, QUERIES[key], ORACLE[key]) == []


def test_the_entry_registers_all():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
