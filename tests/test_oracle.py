"""Every core query against its DuckDB twin over the whole tables, and the ones without a twin for shape."""

from __future__ import annotations

import pytest

from ferrule.plans import completed, extras, fuller, retrieval, streams
from tests.conftest import SF

QUERIES, ORACLE_SQL = {**fuller.QUERIES, **completed.QUERIES, **retrieval.QUERIES, **streams.QUERIES, **extras.QUERIES}, {**fuller.ORACLE_SQL, **completed.ORACLE_SQL, **retrieval.ORACLE_SQL, **streams.ORACLE_SQL, **extras.ORACLE_SQL}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_is_registered(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
