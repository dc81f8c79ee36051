"""Every query with a SQL twin, compared on the smallest given tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert check.compare(got, con.execute(TWINS[name]).fetchdf()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
