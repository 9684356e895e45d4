import pytest

from quern.llm import registry
from tests.conftest import DATA
from tests.oracle import agree, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    agree(registry.QUERIES[name](spark, DATA), connect(DATA), registry.ORACLE_SQL[name])


def test_thirteen_queries_and_the_pipeline():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
