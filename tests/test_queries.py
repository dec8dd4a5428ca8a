"""Every query against its SQL on small data; queries without SQL run and keep their columns."""

import pytest
from docloom.plans import catalog

from tests.oracle import compare, connect

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_its_sql(spark, sf, con, name):
    assert compare(con, QUERIES[name](spark, sf), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "n_findings", "redacted_text"] and out.where("n_findings > 0").count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
