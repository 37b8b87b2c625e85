"""Every registered query with an oracle must give the oracle's rows at the smallest scale."""

import pytest

from floorlake import plans
from tools.check import compare, oracle_connection

ORACLES = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, con, sf_dir):
    ok, _, note = compare(spark, con, plans.QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok is not False, note
