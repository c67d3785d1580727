"""Queries that SQL can express, on the smallest tables."""

import pytest

from loomlog.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, oracle, name):
    df = QUERIES[name](spark, DIR)
    found = oracle.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert set(names) <= set(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, found.fetchall()))
