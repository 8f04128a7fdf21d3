import pytest

from tabsieve.queries import QUERIES, SQL

from .conftest import SF
from .duck import rows_equal


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, name):
    rows_equal(spark, QUERIES[name], SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
