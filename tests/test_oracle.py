"""Every catalogue query with a DuckDB text must give the same rows and types."""

import pytest

from tests.oracle_check import compare, connect
from tillwise.plans import catalog

QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_oracle(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], sf) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["tier"]: r for r in entry.entry(spark).collect()}
    assert set(rows) == {"high_risk", "medium_risk", "low_risk", "total"}
    parts = [rows[t]["customers"] for t in ("high_risk", "medium_risk", "low_risk")]
    assert sum(parts) == rows["total"]["customers"] == 150
