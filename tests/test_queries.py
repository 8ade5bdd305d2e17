"""Every reference query with SQL against it, and those without for rows."""

from __future__ import annotations

import pytest

from arbora import catalog

from .conftest import DATA
from .support import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_merge_action_occurs(spark):
    actions = {r["action"] for r in catalog.QUERIES["pairing_merge_plan"](spark, "/root/testdata/sf0.01").select("action").distinct().collect()}
    assert actions == {"history", "conflict", "send", "receive", "send-new"}
