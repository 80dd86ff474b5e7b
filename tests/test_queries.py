"""Every registered query of the library against its SQL twin, over whole tables."""

import pytest

from docweave.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import connection, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        columns, expected = rows_of_sql(duck, ORACLE_SQL[name])
        assert sorted(df.columns) == columns
        assert rows_of_spark(df) == expected
    else:
        assert df.count() > 0


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
