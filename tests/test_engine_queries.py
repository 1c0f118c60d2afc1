"""Every query of the passage engine against its SQL, at two scales."""

import pytest
from compare import same
from conftest import SF, SMALL

from quire import queries as Q


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_small(spark, name):
    same(Q.queries()[name](spark, SMALL), Q.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_larger(spark, name):
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def test_names():
    assert set(Q.oracle_sql()) == set(Q.queries())


def test_entry(spark):
    import __spark_entry__ as E

    rows = E.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_without_llm(monkeypatch):
    """Without the training-data operators the other queries are still there."""
    import importlib.util

    import __spark_entry__ as E

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("quire.llm", "corpus_pipeline")) else real(n, *a))
    assert set(E.queries()) == set(Q.queries()) and set(E.oracle_sql()) == set(Q.oracle_sql())
