"""Each query of the library against its SQL."""

import pytest
from compare import connect, spark_rows, sql_rows

from noticewright import catalog

WITH_SQL = sorted(catalog.oracle_sql())
WITHOUT = sorted(set(catalog.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    names, want = sql_rows(duck, catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(names)
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", WITHOUT)
def test_runs_whole(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry_imports_without_llm(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "source"]
