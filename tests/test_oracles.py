from __future__ import annotations

import pytest

import __spark_entry__ as entry
from corpusmill.plans import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    assert compare(spark, small, name) is None


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"file_manifest"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["split_idx", "seq", "pos", "token_id", "type_id"]
