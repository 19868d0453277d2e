import pytest

from shardwright.plans import catalogue
from tests.oracle import DATA, same

NAMES = list(catalogue.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    same(catalogue.queries()[name](spark, DATA), catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 13 and sum(r["n"] for r in rows) == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
