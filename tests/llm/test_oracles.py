"""Training-data queries against their SQL."""

import os
import sys

import pytest

from concordat.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    from oracle import compare, duck

    assert compare(duck(sf), queries.ORACLES[name], queries.QUERIES[name](spark, sf)) > 0
