import pytest

from gleaner.plans import registry
from tests.conftest import SMALL
from tests.same import assert_same


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        assert_same(df, duck.sql(registry.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "ord", "hybrid", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
