"""Draws from hash streams: against their SQL twins, and against the distributions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from benchcohort.functions import sampling
from benchcohort.functions.hashing import h, h_sql

CASES = [(0, 0.3), (1, 0.5), (5, 0.2), (12, 0.9), (40, 0.5), (40, 0.0), (40, 1.0), (300, 0.01), (300, 0.97), (10**6, 1e-6),
         (10**6, 0.3), (10**9, 0.5), (3 * 10**9, 0.999)]
MEANS = [1, 2, 9, 16, 17, 100, 12345, 10**8]
R = 3000


def spark_draws(spark, rows, draw):
    df = spark.createDataFrame([(k, n, p) for k, (n, p) in enumerate(rows)], "g int, n long, p double")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(R - 1))).alias("r")).withColumn("base", h(7, F.col("g"), F.col("r")))
    out = {}
    for g, r, k in df.select("g", "r", draw).collect():
        out[g, r] = k
    return out


@pytest.fixture(scope="module")
def binomials(spark):
    return spark_draws(spark, CASES, sampling.binomial_draw(F.col("n"), F.col("p"), F.col("base")))


@pytest.fixture(scope="module")
def poissons(spark):
    return spark_draws(spark, [(m, 0.0) for m in MEANS], sampling.poisson_draw(F.col("n"), F.col("base")))


def twins(rows, ctes):
    values = ", ".join(f"({g}, {n}::BIGINT, {p!r}::DOUBLE)" for g, (n, p) in enumerate(rows))
    sql = f"WITH src AS (SELECT g, n, p, r, {h_sql('7', 'g', 'r')} AS base FROM (VALUES {values}) t(g, n, p), range(0, {R}) q(r)),\n{ctes}"
    return {(g, r): k for g, r, k in duckdb.sql(f"{sql} SELECT g, r, k FROM drawn").fetchall()}


def test_binomial_draws_equal_their_sql(binomials):
    assert twins(CASES, sampling.binomial_draw_ctes("src", "g, r", "drawn")) == binomials


def test_poisson_draws_equal_their_sql(poissons):
    assert twins([(m, 0.0) for m in MEANS], sampling.poisson_draw_ctes("src", "g, r", "drawn")) == poissons


def moments_fit(values, mean, var):
    n = len(values)
    got = sum(values) / n
    spread = sum((v - got) ** 2 for v in values) / (n - 1)
    assert abs(got - mean) <= 4.5 * math.sqrt(var / n) + 1e-12
    assert abs(spread - var) <= 4.5 * var * math.sqrt(3 / n) + 1e-12


@pytest.mark.parametrize("g", range(len(CASES)))
def test_binomial_moments(binomials, g):
    n, p = CASES[g]
    values = [binomials[g, r] for r in range(R)]
    assert all(0 <= v <= n and v == int(v) for v in values)
    moments_fit(values, n * p, n * p * (1 - p))


@pytest.mark.parametrize("g", range(len(MEANS)))
def test_poisson_moments(poissons, g):
    moments_fit([poissons[g, r] for r in range(R)], MEANS[g], MEANS[g])


@pytest.mark.parametrize("g", [3, 4])
def test_binomial_frequencies(binomials, g):
    """Chi-square of all counts with an expectation of 5 or more."""
    n, p = CASES[g]
    seen = [binomials[g, r] for r in range(R)]
    terms = []
    for k in range(n + 1):
        expected = R * math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if expected >= 5:
            terms.append((seen.count(k) - expected) ** 2 / expected)
    assert sum(terms) < len(terms) + 4 * math.sqrt(2 * len(terms))


def test_numpy_draws_equal_columns(spark):
    """The same counts from the same streams: unit draws, sums of a few, rejection."""
    import numpy as np

    from benchcohort.functions import draws
    means = [*range(1, 20), 57, 1000, 12345, 10**8]
    df = spark.createDataFrame([(g, n) for g, n in enumerate(means)], "g int, n long")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("r")).withColumn("base", h(11, F.col("g"), F.col("r")))
    rows = df.select("g", "r", "base", sampling.poisson_draw(F.col("n"), F.col("base")).alias("k")).orderBy("r", "g").collect()
    base = np.array([r.base for r in rows], dtype=np.uint32).reshape(300, -1)
    got = draws.poisson(np.array(means), base)
    assert (got == np.array([r.k for r in rows]).reshape(300, -1)).all()
    z = np.array([0, 2**32 - 1, *sampling_cuts(), *(c - 1 for c in sampling_cuts())], dtype=np.uint32)
    assert draws.poisson1(z).tolist() == [sum(int(v) >= c for c in sampling_cuts()) for v in z]


def sampling_cuts():
    from benchcohort.functions.hashing import POISSON1_CUTS
    return POISSON1_CUTS


def test_numpy_binomials_equal_columns(spark):
    import numpy as np

    from benchcohort.functions import draws
    df = spark.createDataFrame([(g, n, p) for g, (n, p) in enumerate(CASES)], "g int, n long, p double")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(299))).alias("r")).withColumn("base", h(11, F.col("g"), F.col("r")))
    rows = df.select("n", "p", "base", sampling.binomial_draw(F.col("n"), F.col("p"), F.col("base")).alias("k")).collect()
    n, p, base, k = (np.array(x) for x in zip(*rows))
    assert (draws.binomial(n, p, base.astype(np.uint32)) == k).all()
    w = np.array([5, 40, 3, 1, 900, 7])
    counts = draws.multinomial(w, base[:2000].astype(np.uint32))
    assert (counts.sum(axis=1) == w.sum()).all() and np.abs(counts.mean(axis=0) - w).max() < 5 * np.sqrt(w.max() / 2000)
