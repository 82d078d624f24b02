"""Every core query beside its SQL twin on the smallest tables; those without one must run and be stable."""

import pytest

from strataloom.plans import catalogue
from tests.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    assert compare(spark, FOLDER, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name)) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
