"""Every query with SQL agrees with DuckDB; the others return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.checker import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_returns_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["title", "word_count"]
    assert entry(spark).count() == 20
