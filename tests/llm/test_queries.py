"""Registered queries against their SQL."""

import os

import pytest

from stepfold.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, duck, rows_of

SF = os.environ.get("CORPUS_SF", "0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf{SF}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert g == w and [type(x) for x in g] == [type(x) for x in w]
