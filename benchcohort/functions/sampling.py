"""Binomial and Poisson draws from a hash stream, at a cost that does not grow with the counts.

Small expectations are drawn by adding up probabilities (binomial) or unit draws (Poisson);
others by transformed rejection with a fixed hat, which accepts within a few tries whatever
the parameters. A draw depends on its base alone (a 32-bit number, from which it takes a stream
of uniform numbers), so it is the same on any cluster shape and has an SQL twin.

The distributions are exact up to the 32 bits of a uniform number and the rounding of log
factorials, whose differences carry an error of about 1e-16 n ln n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binomial import let, log_factorial
from .hashing import TWO32, poisson1_of, poisson1_of_sql, stream, stream_sql

TRIES = 32  # of a rejection: all fail with a probability below 1e-16
SMALL_MEAN = 10.0  # expectation from which binomial draws are by rejection
SEARCH = 80  # counts added up below it: more have a probability below 2^-100
FEW = 16  # Poisson means up to this are sums of unit draws


def uniform(base: Column, i) -> Column:
    """i-th uniform number of a stream, within (0, 1)."""
    return (stream(base, i) + F.lit(0.5)) / F.lit(TWO32)


def uniform_sql(base: str, i: str) -> str:
    return f"(({stream_sql(base, i)} + 0.5) / {TWO32})"


def _tries(base: Column, attempt) -> Column:
    """The first accepted value of ``attempt(u, v)``, which gives -1 for a rejection; -1 if none is."""
    def step(found, t):
        again = let(F.struct((uniform(base, t * 2) - F.lit(0.5)).alias("u"), uniform(base, t * 2 + 1).alias("v")),
                    lambda x: attempt(x["u"], x["v"]))
        return F.when(found >= 0, found).otherwise(again)

    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(-1.0), step)


def _binomial_by_rejection(n: Column, p: Column, base: Column) -> Column:
    """n p >= 10 and p <= 1/2."""
    def constants(s):
        b = F.lit(1.15) + F.lit(2.53) * s["spread"]
        return let(F.struct(s["n"].alias("n"), s["p"].alias("p"), s["base"].alias("base"), b.alias("b"),
                            (F.lit(-0.0873) + F.lit(0.0248) * b + F.lit(0.01) * s["p"]).alias("a"),
                            ((F.lit(2.83) + F.lit(5.1) / b) * s["spread"]).alias("alpha"),
                            F.floor((s["n"] + F.lit(1.0)) * s["p"]).cast("double").alias("mode"),
                            F.log(s["p"] / (F.lit(1.0) - s["p"])).alias("odds")), with_mode)

    def with_mode(c):
        return let(log_factorial(c["mode"]) + log_factorial(c["n"] - c["mode"]), lambda top: draw(c, top))

    def draw(c, top):
        def attempt(u, v):
            def judge(x):
                k, us = x["k"], x["us"]
                height = F.log(v * c["alpha"] / (c["a"] / (us * us) + c["b"]))
                fits = height <= top - log_factorial(k) - log_factorial(c["n"] - k) + (k - c["mode"]) * c["odds"]
                return (F.when((us >= 0.07) & (v <= F.lit(0.92) - F.lit(4.2) / c["b"]), k)
                        .when((k < 0) | (k > c["n"]), F.lit(-1.0)).when(fits, k).otherwise(F.lit(-1.0)))

            us = F.lit(0.5) - F.abs(u)
            return let(us, lambda w: let(F.struct(
                w.alias("us"), F.floor((F.lit(2.0) * c["a"] / w + c["b"]) * u + c["n"] * c["p"] + F.lit(0.5)).cast("double").alias("k")), judge))

        return let(_tries(c["base"], attempt), lambda k: F.when(k < 0, c["mode"]).otherwise(k))

    spread = F.sqrt(n * p * (F.lit(1.0) - p))
    return let(F.struct(n.alias("n"), p.alias("p"), base.alias("base"), spread.alias("spread")), constants)


def _binomial_by_search(n: Column, p: Column, base: Column) -> Column:
    """n p < 10 and p <= 1/2: how many of the cumulative probabilities lie below a uniform number."""
    def search(c):
        def step(acc, k):
            left = acc["left"] - acc["f"]
            return F.when(acc["left"] < acc["f"], acc).otherwise(F.struct(
                (acc["k"] + F.lit(1.0)).alias("k"), (acc["f"] * (c["n"] - k) / (k + F.lit(1)) * c["odds"]).alias("f"), left.alias("left")))

        start = F.struct(F.lit(0.0).alias("k"), F.exp(c["n"] * F.log1p(-c["p"])).alias("f"), c["u"].alias("left"))
        return F.least(F.aggregate(F.sequence(F.lit(0), F.lit(SEARCH - 1)), start, step)["k"], c["n"])

    return let(F.struct(n.alias("n"), p.alias("p"), (p / (F.lit(1.0) - p)).alias("odds"), uniform(base, 0).alias("u")), search)


def binomial_draw(n: Column, p: Column, base: Column) -> Column:
    """Successes among n trials of probability p, as DOUBLE; 0 for n = 0."""
    def choose(c):
        some = (F.when(c["n"] * c["p"] <= 0, F.lit(0.0)).when(c["n"] * c["p"] < SMALL_MEAN, _binomial_by_search(c["n"], c["p"], c["base"]))
                .otherwise(_binomial_by_rejection(c["n"], c["p"], c["base"])))
        return F.when(c["turned"], c["n"] - some).otherwise(some)

    def turned(c):
        return let(F.struct(c["n"].alias("n"), F.least(c["p"], F.lit(1.0) - c["p"]).alias("p"), c["base"].alias("base"),
                            (c["p"] > 0.5).alias("turned")), choose)

    return let(F.struct(n.cast("double").alias("n"), p.cast("double").alias("p"), base.alias("base")), turned)


def poisson_draw(mean: Column, base: Column) -> Column:
    """Poisson count of a whole-numbered mean >= 1, as DOUBLE."""
    def by_rejection(m):
        b = F.lit(0.931) + F.lit(2.53) * F.sqrt(m)
        return let(F.struct(b.alias("b"), (F.lit(-0.059) + F.lit(0.02483) * b).alias("a"),
                            (F.lit(1.1239) + F.lit(1.1328) / (b - F.lit(3.4))).alias("inverse")), lambda c: draw(m, c))

    def draw(m, c):
        def attempt(u, v):
            def judge(x):
                k, us = x["k"], x["us"]
                height = F.log(v) + F.log(c["inverse"]) - F.log(c["a"] / (us * us) + c["b"])
                return (F.when((us >= 0.07) & (v <= F.lit(0.9277) - F.lit(3.6224) / (c["b"] - F.lit(2.0))), k)
                        .when((k < 0) | ((us < 0.013) & (v > us)), F.lit(-1.0))
                        .when(height <= -m + k * F.log(m) - log_factorial(k), k).otherwise(F.lit(-1.0)))

            return let(F.lit(0.5) - F.abs(u), lambda w: let(F.struct(
                w.alias("us"), F.floor((F.lit(2.0) * c["a"] / w + c["b"]) * u + m + F.lit(0.43)).cast("double").alias("k")), judge))

        return let(_tries(base, attempt), lambda k: F.when(k < 0, F.floor(m).cast("double")).otherwise(k))

    units = F.aggregate(F.sequence(F.lit(1), F.least(mean, F.lit(FEW)).cast("int")), F.lit(0.0),
                        lambda s, i: s + poisson1_of(stream(base, i)))
    return F.when(mean <= FEW, units).otherwise(let(mean.cast("double"), by_rejection))


# ---------------------------------------------------------------- SQL twins
def binomial_draw_ctes(src: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, k) of the draws for the rows (keys, n, p, base) of ``src``; keys are unique."""
    tries = f"unnest(range(0, {TRIES}))"
    return f"""{name}_c AS (
  SELECT {keys}, CAST(n AS DOUBLE) AS n, least(p, 1 - p) AS p, base, p > 0.5 AS turned,
         1.15 + 2.53 * sqrt(n * least(p, 1 - p) * (1 - least(p, 1 - p))) AS b, floor((n + 1.0) * least(p, 1 - p)) AS m
  FROM {src}),
{name}_t AS (SELECT *, {tries} AS t FROM {name}_c WHERE n * p >= {SMALL_MEAN}),
{name}_u AS (SELECT *, {uniform_sql('base', 't * 2')} - 0.5 AS u_, {uniform_sql('base', 't * 2 + 1')} AS v_,
                    -0.0873 + 0.0248 * b + 0.01 * p AS a FROM {name}_t),
{name}_k AS (SELECT *, 0.5 - abs(u_) AS us, floor((2.0 * a / (0.5 - abs(u_)) + b) * u_ + n * p + 0.5) AS k FROM {name}_u),
{name}_a AS (SELECT *, (us >= 0.07 AND v_ <= 0.92 - 4.2 / b) OR (k >= 0 AND k <= n AND
    ln(v_ * (2.83 + 5.1 / b) * sqrt(n * p * (1 - p)) / (a / (us * us) + b))
    <= lgamma(m + 1) + lgamma(n - m + 1) - lgamma(CASE WHEN k BETWEEN 0 AND n THEN k ELSE 0 END + 1)
       - lgamma(n - CASE WHEN k BETWEEN 0 AND n THEN k ELSE 0 END + 1) + (k - m) * ln(p / (1 - p))) AS ok FROM {name}_k),
{name}_f AS (
  SELECT {keys}, n, p, base, turned, m, j, CASE WHEN j > n THEN 0.0 ELSE
         exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(greatest(n - j, 0) + 1) + j * ln(p) + (n - j) * ln(1 - p)) END AS f
  FROM (SELECT *, unnest(range(0, {SEARCH})) AS j FROM {name}_c WHERE n * p > 0 AND n * p < {SMALL_MEAN})),
{name}_s AS (SELECT *, SUM(f) OVER (PARTITION BY {keys} ORDER BY j) <= {uniform_sql('base', '0')} AS below FROM {name}_f),
{name}_all AS (
  SELECT {keys}, any_value(n) AS n, any_value(turned) AS turned, coalesce(arg_min(k, t) FILTER (WHERE ok), any_value(m)) AS k FROM {name}_a GROUP BY {keys}
  UNION ALL
  SELECT {keys}, any_value(n), any_value(turned), least(COUNT(*) FILTER (WHERE below), any_value(n)) FROM {name}_s GROUP BY {keys}
  UNION ALL
  SELECT {keys}, n, turned, 0.0 FROM {name}_c WHERE n * p <= 0),
{name} AS (SELECT {keys}, CASE WHEN turned THEN n - k ELSE k END AS k FROM {name}_all)"""


def poisson_draw_ctes(src: str, keys: str, name: str) -> str:
    """CTE ``name`` (keys, k) of the draws for the rows (keys, n, base) of ``src``, n their means; keys are unique."""
    return f"""{name}_t AS (
  SELECT {keys}, CAST(n AS DOUBLE) AS n, 0.931 + 2.53 * sqrt(n) AS b, t, {uniform_sql('base', 't * 2')} - 0.5 AS u_, {uniform_sql('base', 't * 2 + 1')} AS v_
  FROM (SELECT *, unnest(range(0, {TRIES})) AS t FROM {src} WHERE n > {FEW})),
{name}_u AS (SELECT *, -0.059 + 0.02483 * b AS a, 0.5 - abs(u_) AS us FROM {name}_t),
{name}_k AS (SELECT *, floor((2.0 * a / us + b) * u_ + n + 0.43) AS k FROM {name}_u),
{name}_a AS (SELECT *, (us >= 0.07 AND v_ <= 0.9277 - 3.6224 / (b - 2.0)) OR (k >= 0 AND NOT (us < 0.013 AND v_ > us) AND
    ln(v_) + ln(1.1239 + 1.1328 / (b - 3.4)) - ln(a / (us * us) + b) <= -n + k * ln(n) - lgamma(greatest(k, 0) + 1)) AS ok FROM {name}_k),
{name} AS (
  SELECT {keys}, coalesce(arg_min(k, t) FILTER (WHERE ok), any_value(n)) AS k FROM {name}_a GROUP BY {keys}
  UNION ALL
  SELECT {keys}, CAST(SUM({poisson1_of_sql(stream_sql('base', 'i'))}) AS DOUBLE)
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM {src} WHERE n <= {FEW}) GROUP BY {keys})"""
