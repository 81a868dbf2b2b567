"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

from siltstream.plans import CATALOG

from oracle import SF, connect, rows


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_oracle(spark, name):
    entry = CATALOG[name]
    got = rows(entry.build(spark, SF).toPandas())
    want = rows(connect().sql(entry.sql).df())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
