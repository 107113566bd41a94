"""The queries of this subpackage that have SQL, against it at sf0.01."""

import pytest

from marlstone.llm import registry
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLES[name], "/root/testdata/sf0.01") > 100
