import pytest

from ampliscope.plans import flows as catalog

from .conftest import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
