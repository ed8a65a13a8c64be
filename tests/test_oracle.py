"""Every registered query against its SQL on the smallest test tables."""

import pytest
from compare import compare, connect

from doctables.workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    verdict, _ = compare(spark, con, sf, name)
    assert verdict.startswith("ok" if name in ORACLES else "rows only"), verdict


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
