"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import pytest

from cuegrid.plans import catalogue

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, same):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, SQL[name])
    else:
        assert df.count() > 0


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
