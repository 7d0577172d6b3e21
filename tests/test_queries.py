"""Every registered query, next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from candidata.plans import registry
from conftest import SMALL

QUERIES, SQL = registry.QUERIES, registry.SQL
PYTHON = {"infer", "extract_documents", "extract_despite_bad_json", "evaluate_with_model"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    """Same rows as the SQL; no cross join, and Python only where a model is asked."""
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and ("MapInPandas" in plan) == (name in PYTHON)
    if name in SQL:
        assert compare.differences(spark, con, SMALL, lambda *_: df, SQL[name]) == []
    else:
        assert df.count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["job_id", "Rank", "Candidate Name"]
