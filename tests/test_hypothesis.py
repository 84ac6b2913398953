"""Randomised properties (hypothesis); each example is one batched Spark job."""

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from benchcohort.functions import hashing
from benchcohort.functions.binomial import exact_binomial_ci, exact_binomial_ci_py
from benchcohort.operators import stats

SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@st.composite
def x_n(draw):
    n = draw(st.integers(min_value=1, max_value=400))
    return draw(st.integers(min_value=0, max_value=n)), n


@SETTINGS
@given(st.lists(x_n(), min_size=1, max_size=12))
def test_exact_ci_matches_python_twin(spark, pairs):
    df = spark.createDataFrame(pairs, "x long, n long")
    got = df.select("x", "n", exact_binomial_ci(F.col("x"), F.col("n")).alias("ci")).collect()
    for r in got:
        lo, hi = exact_binomial_ci_py(r.x, r.n)
        assert r.ci.lcl == pytest.approx(lo, abs=1e-9)
        assert r.ci.ucl == pytest.approx(hi, abs=1e-9)
        assert r.ci.lcl <= r.x / r.n <= r.ci.ucl


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 2 ** 32 - 1), st.integers(0, 10 ** 6)), min_size=1, max_size=30))
def test_stream_matches_sql_twin_on_random_inputs(spark, pairs):
    df = spark.createDataFrame(pairs, "b long, i long")
    got = sorted((r.b, r.i, r.z) for r in df.select("b", "i", hashing.stream(F.col("b"), F.col("i")).alias("z")).collect())
    values = ", ".join(f"({b}, {i})" for b, i in pairs)
    sql = sorted(duckdb.sql(f"SELECT b, i, {hashing.stream_sql('b', 'i')} FROM (VALUES {values}) t(b, i)").fetchall())
    assert got == sql


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200),
       st.sampled_from([0.0, 0.025, 0.5, 0.9, 1.0]))
def test_exact_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = stats.exact_quantiles(df, "g", "v", [p]).first().q
    assert got == pytest.approx(float(np.quantile(np.array(values), p)), rel=1e-12, abs=1e-9)


def _smd_matrix(p, q):
    """Yang & Dalton: sqrt((p-q)' S^-1 (p-q)) over the first k-1 levels,
    S = (S_p + S_q) / 2 with S_x = diag(x) - x x'."""
    p, q = np.asarray(p[:-1]), np.asarray(q[:-1])
    s = (np.diag(p) - np.outer(p, p) + np.diag(q) - np.outer(q, q)) / 2
    d = p - q
    return float(np.sqrt(d @ np.linalg.solve(s, d)))


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 60)), min_size=2, max_size=6))
def test_categorical_smd_matches_matrix_form(spark, counts):
    from benchcohort.operators import tableone
    rows = [("A", f"l{i}") for i, (a, _) in enumerate(counts) for _ in range(a)]
    rows += [("B", f"l{i}") for i, (_, b) in enumerate(counts) for _ in range(b)]
    df = spark.createDataFrame(rows, "s string, v string")
    got = tableone.smd_categorical(tableone.categorical(df, "s", ["v"])).first().smd
    na, nb = sum(a for a, _ in counts), sum(b for _, b in counts)
    expected = _smd_matrix([a / na for a, _ in counts], [b / nb for _, b in counts])
    assert got == pytest.approx(expected, rel=1e-9, abs=1e-12)
