"""Every query is registered and runs on the given tables; those with an oracle agree with it."""

import re

import pytest

import __spark_entry__ as entry
from oracle import mismatch, oracle_rows
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registered():
    own = set(QUERIES) | {"pipeline"}
    assert own <= set(entry.queries()) and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and not re.search("BatchEvalPython", plan)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        assert mismatch(df.columns, rows, *oracle_rows(ORACLES[name], SF)) is None
