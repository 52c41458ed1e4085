"""The driver contract holds without the optional corpus operators."""

import importlib
import sys

import pytest

import __spark_entry__
from tillsight import catalog


@pytest.mark.parametrize("missing", ["tillsight.llm", "tillsight.llm.catalog", "xxhash", "corpus_pipeline"])
def test_queries_without_an_optional_part(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith(("tillsight.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        entry = importlib.reload(__spark_entry__)
        assert set(entry.queries()) >= set(catalog.queries())
        assert set(entry.oracle_sql()) <= set(entry.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
