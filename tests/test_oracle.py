"""Every registered query against its DuckDB oracle on the small test tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import duck, normalise
from tests.conftest import SF_SMALL
from mercato.plans.registry import QUERIES as CORE

QUERIES = {name: make for name, make in entry.queries().items() if name in CORE}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in CORE}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle_or_is_documented():
    assert set(ORACLE) == set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["order_month", "revenue", "orders"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    sc, sr = normalise(sdf.columns, srows, strict=True)
    oc, orr = normalise(ocols, orows, strict=True)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr
