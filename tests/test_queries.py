"""Every query with an SQL equivalent gives the SQL's rows."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


@pytest.mark.parametrize("name", ["principal_components", "significant_features", "holdout_split", "subject_scores"])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert len(df.columns) == 27 and df.count() == 10


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
