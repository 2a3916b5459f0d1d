"""Every registered query against its DuckDB oracle (or a run, for rows-only keys) on
the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tessera.plans import ORACLE, QUERIES
from tests.oracle_check import compare, duck

SQL = dict(ORACLE)
KEYS = sorted(QUERIES)      # the training-data queries have tests of their own


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_sql_key_has_a_query():
    assert set(SQL) <= set(E.queries())


PYTHON_ALLOWED = {"score_mapinpandas"}   # user-model path
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, small_dir, con, key):
    df = QUERIES[key](spark, small_dir)
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key not in PYTHON_ALLOWED:
        assert not any(n in plan for n in PYTHON_NODES), f"python node in {key}"
    if key not in SQL:              # checked by content elsewhere (see the README's table of rows-only keys)
        assert rows
        return
    cur = con.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    ok, msgs = compare(rows, df.columns, cur.fetchall(), dcols)
    assert ok, msgs


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["chain", "grp", "prob", "aa", "position", "mean_delta"]
    assert df.count() > 0
