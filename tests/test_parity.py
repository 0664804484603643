"""Every query of the library against its SQL, or for those without one that it runs and has rows."""

import pytest
from conftest import same_rows

from larkspan import catalogue

catalogue.load()


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(name, spark, data, duck):
    ours, theirs = same_rows(catalogue.QUERIES[name](spark, data), duck, catalogue.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
