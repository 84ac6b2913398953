"""Column-expression building blocks: exact intervals, hashing, rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from benchcohort.functions import hashing
from benchcohort.functions.binomial import exact_binomial_ci, exact_binomial_ci_py, fraction_terms
from benchcohort.functions.rules import (CANONICAL_MODEL_RULES, rename_columns, resolve_assign_rules)

KNOWN = [(50, 100, 0.398321, 0.601679), (862, 1000, 0.839057, 0.882786),
         (0, 10, 0.0, 0.308497), (10, 10, 0.691503, 1.0)]


def test_exact_binomial_known_values(spark):
    df = spark.createDataFrame([(x, n) for x, n, _, _ in KNOWN], "x long, n long")
    got = {(r.x, r.n): (r.ci.lcl, r.ci.ucl)
           for r in df.select("x", "n", exact_binomial_ci(F.col("x"), F.col("n")).alias("ci")).collect()}
    for x, n, lo, hi in KNOWN:
        assert got[(x, n)][0] == pytest.approx(lo, abs=1e-6)
        assert got[(x, n)][1] == pytest.approx(hi, abs=1e-6)
        py = exact_binomial_ci_py(x, n)
        assert got[(x, n)][0] == pytest.approx(py[0], abs=1e-10)
        assert got[(x, n)][1] == pytest.approx(py[1], abs=1e-10)


def test_exact_binomial_contains_point_and_large_n(spark):
    rows = [(3, 17), (1, 2), (499, 1000), (123456, 1000000)]
    df = spark.createDataFrame(rows, "x long, n long")
    for r in df.select("x", "n", exact_binomial_ci(F.col("x"), F.col("n")).alias("ci")).collect():
        assert r.ci.lcl <= r.x / r.n <= r.ci.ucl
        assert 0.0 <= r.ci.lcl < r.ci.ucl <= 1.0


def test_hash_matches_sql_twin(spark):
    got = spark.range(1).select(hashing.h(46664, 7, 3).alias("v")).first().v
    assert got == 674961460
    sql = duckdb.sql(f"SELECT {hashing.h_sql('46664', '7', '3')}").fetchall()[0][0]
    assert sql == got


def test_stream_matches_sql_twin(spark):
    base = 674961460
    df = spark.range(0, 50).select("id", hashing.stream(F.lit(base), F.col("id")).alias("z"))
    got = {r.id: r.z for r in df.collect()}
    expr = hashing.stream_sql(str(base), "i")
    sql = dict(duckdb.sql(f"SELECT i, {expr} FROM range(0, 50) t(i)").fetchall())
    assert got == sql
    assert all(0 <= v < 2 ** 32 for v in got.values())


@pytest.mark.parametrize("conf", [0.5, 0.95, 0.999])
def test_exact_limits_solve_their_equation_for_any_n(spark, conf):
    """By the JVM's own incomplete beta function, half of what is left out lies beyond each limit, give or take 1e-10."""
    tail = spark._jvm.org.apache.commons.math3.special.Beta.regularizedBeta
    cases = sorted({(min(n, round(f * n)), n) for n in (1, 2, 7, 40, 10**3, 10**5, 10**7, 10**10)
                    for f in (0, 1e-9, 1e-4, 0.03, 0.5, 0.97, 1)} | {(1, 10**9), (10**9 - 1, 10**9)})
    df = spark.createDataFrame(cases, "x long, n long")
    half, off = (1 - conf) / 2, 1e-10
    for r in df.select("x", "n", exact_binomial_ci(F.col("x"), F.col("n"), conf).alias("ci")).collect():
        lo, hi = r.ci
        assert (lo == 0.0) == (r.x == 0) and (hi == 1.0) == (r.x == r.n)
        above = lambda p: tail(min(max(p, 0.0), 1.0), float(r.x), float(r.n - r.x + 1), 1e-15, 10**6)
        if r.x > 0:
            assert above(lo - off) <= half <= above(lo + off)
            assert lo < 1e-6 or above(lo) == pytest.approx(half, rel=1e-5)
        below = lambda q: tail(min(max(q, 0.0), 1.0), float(r.n - r.x), float(r.x + 1), 1e-15, 10**6)
        if r.x < r.n:
            assert below(1 - hi - off) <= half <= below(1 - hi + off)


def test_exact_limits_cost_the_same_for_any_n(spark):
    """The number of terms depends on the confidence alone."""
    rows = lambda n: spark.createDataFrame([(n // 3, n)], "x long, n long")
    plans = [rows(n).select(exact_binomial_ci(F.col("x"), F.col("n"))).first()[0] for n in (10**2, 10**10)]
    assert plans[0].ucl - plans[0].lcl > 1000 * (plans[1].ucl - plans[1].lcl) > 0
    assert fraction_terms(0.95) < 130 and fraction_terms(0.999) < fraction_terms(0.5) < 1000


def test_poisson_weights_have_mean_one(spark):
    df = spark.range(0, 200000).select(hashing.poisson1_of(hashing.stream(F.lit(12345), F.col("id"))).alias("w"))
    row = df.agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
    assert row.m == pytest.approx(1.0, abs=0.02)
    assert row.v == pytest.approx(1.0, abs=0.03)


def test_split_share_close_to_70_percent(spark):
    df = spark.range(0, 100000).select(hashing.in_train(F.lit(1221), F.col("id")).cast("int").alias("t"))
    assert df.agg(F.avg("t")).first()[0] == pytest.approx(0.70, abs=0.01)


def test_rename_rules():
    raw = ["V1", "Comorb_AcctBal_cont", "Baseline_Number.of.grps.previously", "Outcome.Inpatient.visit.any_3mo",
           "Days_Followup", "Baseline_Baseline_TotalPrice_cont"]
    assert rename_columns(raw) == ["v1", "cci_acctbal", "baseline_prior.med.groups", "outcome_ip.visit.any.03mo",
                                   "days_followup", "baseline_totalprice"]
    with pytest.raises(ValueError):
        rename_columns(["A_cont", "a"])


def test_canonical_cascade_resolves_to_constants():
    resolved = dict(resolve_assign_rules(CANONICAL_MODEL_RULES))
    assert resolved["llama-3.3-70b|llama3_3"] == "Llama 3.3 70B"
    assert resolved["o3"] == "o3"


def test_model_names(spark):
    from benchcohort.operators.scorecard import clean_model, improvement_label, with_model_names
    rows = [("llama_mav4_choose_best", "badges"), ("databricks-llama-4-maverick-rag", "med_helm"),
            ("openai_o3-prompt2", "cases"), ("click-enhanced-prompt", "rubric")]
    out = []
    for raw, src in rows:
        df = spark.createDataFrame([(raw,)], "m string").select(clean_model(F.col("m"), src).alias("Model_Orig"))
        r = with_model_names(df).select("Model", "Improve", improvement_label(F.col("Improve")).alias("L")).first()
        out.append((r.Model, r.Improve, r.L))
    assert out == [("Llama 4 Maverick-alexandria_p", "-alexandria_p", "A"), ("Llama 4 Maverick-multi", "-multi", "M"),
                   ("o3-prompt2", "-prompt2", "P2"), ("click-prompt", "-prompt", "P")]
