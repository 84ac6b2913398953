"""Every catalogue query against its DuckDB oracle on the smallest tables;
rows-only queries must run and return a stable schema. Every plan is also
checked for cross joins (cartesian / nested-loop) and Python evaluation
nodes: built-in expressions only."""

import pytest

import __spark_entry__ as entry
from benchcohort.plans import ORACLES as CATALOGUE_SQL
from benchcohort.plans import QUERIES as CATALOGUE
from benchcohort.plans.check import compare, oracle_connection

from .conftest import SF_SMALL

QUERIES = CATALOGUE
ORACLES = CATALOGUE_SQL
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")
ML = {"treatment_model", "feature_importance", "outcome_model", "cv_outcome_model", "aipw_ml", "aipw_forest"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


def _check_plan(name, df):
    plan = df._jdf.queryExecution().toString()
    bad = [f for f in FORBIDDEN if f in plan]
    assert not bad, f"{name}: {bad}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    _check_plan(name, df)
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    _check_plan(name, df)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_every_query_but_ml_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ML


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["Bench", "Model", "Model_Orig", "Improve"]
    assert {"Best", "Worse", "BestMeta", "Progress", "Improve_Last"} <= set(df.columns)
