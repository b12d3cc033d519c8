"""Every registered query runs; those with an oracle give the oracle's table."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

# models with their own property tests
MODELS = {name for name in entry.queries() if name not in entry.oracle_sql()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf_dir, con, name):
    assert difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_the_hot_posts(spark):
    rows = entry.entry(spark).collect()
    assert [r["event_rank"] for r in sorted(rows, key=lambda r: r["event_rank"])] == [1, 2]
    assert rows[0]["cluster"] != rows[1]["cluster"]
