"""Every market-data query against DuckDB's rows over the same files."""

import pytest

from tests.compare import SMALL, difference
from tickloom.plans import directory, records, registry, reports, streams  # noqa: F401 - importing them registers their queries


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    assert not difference(registry.QUERIES[name](spark, SMALL), duck, registry.SQL[name])


def test_all_queries_are_held_against_something():
    assert set(registry.QUERIES) == set(registry.SQL)
