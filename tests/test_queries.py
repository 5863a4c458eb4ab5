"""Every registered query runs; those with a SQL oracle agree with it."""
import pytest

import __spark_entry__ as entry
from compare import canon, connected

SLOW = {"dense_chain_verdicts", "per_type_process", "whole_run", "text_embedding"}   # minutes each; run by scripts/check_queries.py


@pytest.fixture(scope="module")
def con(sf):
    return connected(sf)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
