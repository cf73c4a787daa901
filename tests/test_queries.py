"""Every query that has SQL gives DuckDB's rows; the others run."""

import pytest

from oracle import compare, oracle
from tessera.plans import hospital, interchange, language, learning, monitoring, profiling, retail, shop
from tessera.streaming import windows

from conftest import DATA

QUERIES = {name: q for plan in (retail, profiling, hospital, monitoring, language, learning, interchange, windows, shop) for name, q in plan.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return oracle(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    run, sql = QUERIES[name]
    got = run(spark, f"{DATA}/sf0.001")
    if sql:
        compare(got, con, sql)
    else:
        assert got.count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
