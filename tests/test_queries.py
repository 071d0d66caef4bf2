import pytest

from gatewright.plans.catalog import ORACLES, QUERIES

from oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert_same(QUERIES[name](spark, SF), db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r.alignment for r in __spark_entry__.entry(spark).collect()} == {"acceptance", "period_end"}
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
