import pytest
from conftest import SMALL, same_as_sql

from spindrift.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_all_rows_come_back(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op1_language_id", "op2_mixing", "op7_toxicity"):
        assert QUERIES[name](spark, SMALL).count() == n
