"""Every registered core query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare, duck
from unifold import registry


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf, con, name):
    got = registry.queries()[name](spark, sf).toArrow()
    want = con.execute(registry.oracle_sql()[name]).to_arrow_table()
    assert compare(got, want) == ""
