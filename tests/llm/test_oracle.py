"""Training-data queries against SQL on the smallest tables."""

import pytest

from foldscape.llm.catalog import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")
