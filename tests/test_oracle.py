"""Every registered query equals its SQL on DuckDB over the same tables."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_rule_query_has_sql():
    # Operators for training data that SQL can't express have tests of their own.
    llm = entry.llm_queries()
    others = set(llm.queries()) - set(llm.oracle_sql()) if llm else set()
    assert set(entry.queries()) - others == set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ours, theirs = compare(spark, con, name, SF_DIR)
    assert ours == theirs
    assert ours[0]


def test_entry_has_rows_and_a_stable_schema(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["s", "p", "o"]
    assert frame.count() > 0
