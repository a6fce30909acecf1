import pytest
from conftest import SMALL, same_as_sql

from spindrift.plans import stage_queries  # noqa: F401 - adds its queries
from spindrift.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
