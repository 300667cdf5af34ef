"""Every registered query outside the corpus operators runs; those with SQL return what the SQL does."""

import compare
import pytest
from conftest import SMALL

from marlstone import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLE_SQL:
        assert compare.same(df, registry.ORACLE_SQL[name], SMALL) is None
    else:
        assert df.columns
        df.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
