"""Every query of the library against its SQL, over the smallest tables."""

import pytest

from podium.plans import registry
from tests import oracle

SF = oracle.folder("sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.differences(registry.queries()[name](spark, SF), con, SQL[name]) == ""


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_the_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).take(1)
