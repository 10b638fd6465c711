"""Every query with oracle SQL agrees with it; the others run."""

import pytest
from oracle import compare, connect

from corpuslab.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in registry.ORACLE_SQL:
        assert compare(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_dir) is None
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row["n"] > 0 and 0 <= row["precision_at_k"] <= 1
