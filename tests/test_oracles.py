"""Every registered query against its SQL on the small tables."""

import pytest

from conftest import SF
from glyphline.plans.check import compare
from glyphline.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    verdict, detail = compare(spark, duck, name, SF)
    assert verdict == "ok", detail


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
