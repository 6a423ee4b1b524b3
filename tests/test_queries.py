"""Every query of the network engine against DuckDB; those without SQL must give rows."""

import pytest

import calorgrid.plans  # noqa: F401
from calorgrid.queries import ORACLES, QUERIES
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert same(df, connect(sf_dir), ORACLES[name]) > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
