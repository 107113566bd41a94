"""Every base query against its SQL at sf0.01."""

import pytest

from marlstone.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLES[name], SF) > 0


def test_every_base_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
