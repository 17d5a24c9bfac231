import pytest
from oracle import assert_same

from corpusmill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, tiny, name):
    assert_same(catalogue.QUERIES[name](spark, tiny), catalogue.ORACLE_SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["lang", "sequences", "tokens"]
