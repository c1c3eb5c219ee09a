import harness
import pytest

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def con(sf_dir):
    return harness.connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    problem = harness.compare(entry_points.queries()[name](spark, sf_dir), con, entry_points.oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 100


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(entry_points.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert entry_points.queries()[name](spark, sf_dir).count() > 0
