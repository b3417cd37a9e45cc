"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from historymine.bindings.oracle import ORACLE
from historymine.bindings.queries import QUERIES
from tests.compare import DATA, connect, difference

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
