"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.compare import check, connect
from threadloom.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(CATALOG))
def test_query(spark, con, key):
    # On these small tables a result may be empty, if the SQL's is empty as well.
    assert check(con, spark, CATALOG[key], SF) in (None, "EMPTY")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
