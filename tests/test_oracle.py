"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from planmatch.plans.oracle import ORACLE
from planmatch.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 3 and {r["level"] for r in rows} == {1}


def test_every_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert set(QUERIES) - set(contract.oracle_sql()) == {"ann_topk"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, con, sf_dir, name):
    found = contract.queries()[name](spark, sf_dir)
    assert differences(found, con, contract.oracle_sql()[name]) == []
