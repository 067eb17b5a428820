"""Operators that SQL can express, against DuckDB on the given tables."""

import pytest

from checks.compare import duck, normalise
from mercato.llm.registry import ORACLE, QUERIES
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    frame = QUERIES[name](spark, SF_SMALL)
    res = duck(SF_SMALL).execute(ORACLE[name])
    columns, rows = normalise([d[0] for d in res.description], res.fetchall(), strict=True)
    got_columns, got = normalise(frame.columns, [tuple(r) for r in frame.collect()], strict=True)
    assert got_columns == columns
    assert got == rows


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
