"""Every query with an SQL twin gives the same rows."""

from __future__ import annotations

import pytest

from quotemill.catalog import QUERIES
from quotemill.oracles import ORACLES
from tests.compare import compare, connect, schemas
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    types, expected_types = schemas(df, con, ORACLES[name])
    assert types == expected_types
    found, expected, extra, missing = compare(df, con, ORACLES[name])
    assert found == expected > 0
    assert not extra and not missing
