"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks import queries
from checks.compare import compare
from checks.oracle import oracle_sql
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_sql(spark, name):
    assert compare(spark, SF_DIR, name) == ""


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle_sql())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 250
    assert "strategy" in df.columns
