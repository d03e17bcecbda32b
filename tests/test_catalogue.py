import pytest
from oracle import SF, duck, rows
from pyspark.sql import functions as F

from ballast.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck(SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_all_rows(spark, name):
    if name.startswith("wc_"):  # which worker counted isn't for SQL to say, what was counted is
        got = QUERIES[name](spark, SF).groupBy("ws", "key", "word").agg(F.sum("cnt").alias("cnt"))
        assert rows(got.toPandas()) == rows(duck(SQL["wc_hashing"]))
    else:
        assert QUERIES[name](spark, SF).count() == (1000 if name.startswith("route_") else 800)


def test_entry_module_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
