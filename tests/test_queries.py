"""Registered queries against their SQL twins on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as E
from tallyloom.plans import load_all
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def outcomes(spark):
    """What became of every query; four run at a time, as most of the time goes into planning small jobs."""
    con = connect(SF)

    def one(name):
        try:
            df = REGISTRY.QUERIES[name](spark, SF)
            if name not in REGISTRY.ORACLES:
                return df.count() >= 0, ""
            ok, *_, detail = compare(name, df, con.cursor(), REGISTRY.ORACLES[name])
            return ok, detail
        except Exception as e:  # told by the query's own test
            return False, repr(e)[:2000]

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(REGISTRY.QUERIES, pool.map(one, REGISTRY.QUERIES)))


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(outcomes, name):
    """Every query runs, and equals its SQL where it has one."""
    ok, detail = outcomes[name]
    assert ok, detail


def test_registry_is_consistent():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
