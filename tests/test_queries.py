"""Every registered query against DuckDB on the smallest tables."""

import decimal

import pytest

from loomlog.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    q = QUERIES[name]
    df = q.run(spark, DIR)
    rows = df.collect()
    if q.sql is None:
        assert rows
        return
    found = oracle.execute(q.sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([plain(r[n]) for n in names]) for r in rows) == sorted(str([plain(x) for x in r]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
