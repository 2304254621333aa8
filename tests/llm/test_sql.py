import pytest

from tests.compare import compare, duck
from unifold.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    got = registry.queries()[name](spark, sf).toArrow()
    assert compare(got, duck(sf).execute(registry.oracle_sql()[name]).to_arrow_table()) == ""
