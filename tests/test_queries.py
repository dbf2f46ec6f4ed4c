"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from oracle import compare, connect

from docframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


# Queries without SQL, with the plain version that stands for it.
NO_SQL = {
    "split_recursive": "test_packing.py: one walk over each whole group",
    "retrieve_hybrid": "test_operators.py: lists fused in Python",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert name in ORACLES or name in NO_SQL
    ok, note = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
