import pytest

from quern.plans import registry
from tests.conftest import DATA
from tests.oracle import agree, connect


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    agree(registry.QUERIES[name](spark, DATA), con, registry.ORACLE_SQL[name])


def test_every_query_is_registered(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
