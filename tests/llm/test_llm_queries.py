import os

import pytest

import oracles
from murmura.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracles.SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    oracles.compare(spark, oracles.connection(), name, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, oracles.SF).count() > 0
