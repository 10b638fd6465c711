"""The queries of the subpackage that have SQL agree with it."""

import pytest
from oracle import compare, connect

from corpuslab.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_llm_query(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) is None
