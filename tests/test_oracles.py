"""Every registered query against its SQL on the smallest tables."""

import pytest

from docspark.plans import QUERIES
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name]
    got = query(spark, FOLDER).toArrow()
    if query.oracle is None:
        assert got.num_rows > 0
        return
    assert difference(got, con.execute(query.oracle).to_arrow_table()) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
