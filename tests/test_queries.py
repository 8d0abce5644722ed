"""Every registered query of the correspondence operators against its SQL."""

import pytest
from duck import connect, rows

import missiva.plans.book_queries  # noqa: F401
import missiva.plans.directory_queries  # noqa: F401
import missiva.plans.people_queries  # noqa: F401
import missiva.plans.record_queries  # noqa: F401
import missiva.plans.scope_queries  # noqa: F401
import missiva.plans.stream_queries  # noqa: F401
from missiva.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_point_works_without_the_corpus_operators(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("missiva.llm") or n == "corpus_pipeline" else find(n, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert __spark_entry__.entry(spark).limit(1).count() == 1
