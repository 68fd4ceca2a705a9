"""Every registered query over the small tables against its SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from kvlake.plans.catalog import ORACLE_SQL, QUERIES

from .oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("the test tables are not here")
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name]) == []
