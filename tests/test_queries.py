"""Every registered query against its oracle."""

import re

import pytest

import __spark_entry__ as entry
from oracle import mismatch, oracle_rows
from tidemark.plans import REGISTRY

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = dict(REGISTRY), {name: query.sql for name, query in REGISTRY.items() if query.sql}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # nothing pairs all rows with all rows, and no window runs without a group
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    for window in re.findall(r"Window \[.*", plan):
        assert re.search(r"\], \[[^\[\]]+\], \[[^\[\]]+\]$", window.strip()), window
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name in ORACLES:
        assert mismatch(df.columns, rows, *oracle_rows(ORACLES[name], SF)) is None


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_the_restored_table(spark):
    df = entry.entry(spark)
    assert df.columns == ["pk", "val"]
    assert df.count() > 0
