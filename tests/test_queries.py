"""Every registered query of the library: against its SQL where it has one, else that it gives rows."""

import os

import pytest
from oracle import assert_same, connect

from ledgerline.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert not catalog.QUERIES[name](spark, SMALL).isEmpty()


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    for gone in [m for m in sys.modules if m.startswith("ledgerline.llm")] + ["ledgerline.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import ledgerline

    monkeypatch.delattr(ledgerline, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "e2_fusion_domains" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
