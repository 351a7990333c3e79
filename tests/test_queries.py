"""Every query of the engine against its SQL, or at least against its shape."""

import pytest
from tests.sqlcheck import assert_same

from hiersum.queries import ORACLES, QUERIES, SOLVES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert_same(spark, sf, QUERIES[name], ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(SOLVES))
def test_solves_run(spark, sf, name):
    assert SOLVES[name](spark, sf).count() == 1500


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1500
    assert set(e.oracle_sql()) <= set(e.queries())
