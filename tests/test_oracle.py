"""Every query with SQL agrees with DuckDB on the smallest tables; the others return rows."""

import pytest

from strayfield.plans.registry import all_queries, all_sql
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()
SLOW = {"j7_fuse_masks"}  # covered by brute force in test_raster


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got)


def test_registry_needs_no_session():
    assert set(SQL) <= set(QUERIES)
