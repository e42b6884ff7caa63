import pytest
from compare import connect, difference

from quillgraph.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(registry.queries()[name](spark, sf_dir), con, registry.oracle_sql()[name]) is None
