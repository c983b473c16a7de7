"""Every registered query against its SQL, and the contract of the entry points."""

from __future__ import annotations

import inspect

import oracle
import pytest

from lectern.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.views(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_rows_equal_sql(spark, con, name):
    assert oracle.difference(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLE[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(len(inspect.signature(q).parameters) >= 2 for q in entry.queries().values())
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "text_id", "score", "external_id", "title_english", "code"]
