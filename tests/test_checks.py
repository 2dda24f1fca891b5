"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from harness import compare, connect

from weblode.plans import registry

registry.load()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.CHECKS))
def test_query_matches_sql(spark, duck, name):
    problems = compare(spark, duck, FOLDER, name, registry.QUERIES[name], registry.CHECKS[name])
    assert [p for p in problems if p != "check is empty"] == []


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.CHECKS)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["site", "link_class", "links", "pages", "targets"]
