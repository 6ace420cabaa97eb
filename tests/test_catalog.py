import pytest

from tests.oracle import same
from tidelog.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["k", "c1", "c2"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.value_range(spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in text and "o_totalprice" not in text.split("ReadSchema")[1]


def test_scan_k_keeps_k_rows_in_each_task(spark):
    assert "TakeOrderedAndProject" in plan(catalog.scan_k(spark, "/root/testdata/sf0.001"))


def test_no_python_and_no_cartesian_product(spark):
    for name, query in catalog.QUERIES.items():
        text = plan(query(spark, "/root/testdata/sf0.001"))
        assert "Python" not in text and "CartesianProduct" not in text, name
