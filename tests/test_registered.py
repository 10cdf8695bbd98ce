"""Every registered query against its SQL on the smallest data."""

import pytest
from oracle import compare, connect

from spanloom.workloads import all_workloads

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_workloads()))
def test_matches_sql(spark, db, name):
    query, sql = all_workloads()[name]
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, db, query, sql, SF) is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
