"""Exact (Clopper-Pearson) binomial confidence limits as native Spark columns.

The lower limit for x successes in n solves P(X >= x | p) = alpha/2. That tail is
the regularised incomplete beta function I_p(x, n - x + 1): a prefactor times a
continued fraction. The upper limit is one minus the lower limit of the failures.

The equation is solved by Newton steps on ln I as a function of the log odds, which is
increasing and concave: a step from the left stays left of the root and one from the
right lands left of it, so every start converges; steps are clamped below the mean,
where the fraction converges. At the limits p is about ``z`` standard deviations below
the mean, and there the fraction needs a number of terms that depends on z alone, not
on n (measured for n from 1 to 1e10), so an interval costs the same for every n.

The prefactor is a binomial probability in Loader's form: Stirling corrections and
deviances instead of differences of large log factorials, so it loses no digits as n
grows. Spark has no ``lgamma``; corrections come from a small exact table below 17
and the Stirling series (to z^-7) above it, accurate to about 1e-14.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 45  # of the bisection in the plain twins (Python here, SQL in the oracles)
NEWTON_STEPS = 6
_SMALL = 17
_LOG_FACT_SMALL = [math.lgamma(k + 1) for k in range(_SMALL)]
_HALF_LN_2PI = 0.5 * math.log(2 * math.pi)
_STIRLING_ERROR_SMALL = [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - _HALF_LN_2PI for k in range(1, _SMALL)]


def log_factorial(k: Column) -> Column:
    """ln(k!) for integer k >= 0."""
    z = k.cast("double") + F.lit(1.0)
    stirling = ((z - F.lit(0.5)) * F.log(z) - z + F.lit(_HALF_LN_2PI)
                + F.lit(1.0) / (F.lit(12.0) * z)
                - F.lit(1.0) / (F.lit(360.0) * z * z * z)
                + F.lit(1.0) / (F.lit(1260.0) * z * z * z * z * z)
                - F.lit(1.0) / (F.lit(1680.0) * z * z * z * z * z * z * z))
    table = F.array(*[F.lit(v) for v in _LOG_FACT_SMALL])
    return F.when(k < F.lit(_SMALL), F.element_at(table, (k + F.lit(1)).cast("int"))).otherwise(stirling)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (a lambda over a Column).

    Catalyst expression trees are not shared, so a value used many times is
    copied many times; binding it through a one-element ``transform`` keeps
    the tree linear in size and evaluates the value once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def stirling_error(k: Column) -> Column:
    """ln(k!) less Stirling's approximation, for integer k >= 1."""
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (k * k)) / (k * k)) / (k * k)) / k
    table = F.array(*[F.lit(v) for v in _STIRLING_ERROR_SMALL])
    return F.when(k < F.lit(float(_SMALL)), F.element_at(table, F.greatest(k, F.lit(1.0)).cast("int"))).otherwise(series)


def fraction_terms(conf: float) -> int:
    """Terms after which the continued fraction has settled at the limits of this confidence."""
    z = NormalDist().inv_cdf((1.0 + conf) / 2.0)
    return math.ceil(30 + 330 / (z * z))


def _beta_fraction(a: Column, b: Column, p: Column, terms: int) -> Column:
    """The continued fraction of I_p(a, b) for p below the mean, from its last term inwards."""
    one = F.lit(1.0)

    def step(inner, m):
        m2 = a + m + m
        even = m * (b - m) * p / ((m2 - one) * m2)
        odd = (a + m) * (a + b + m) * p / (m2 * (m2 + one))
        return one + even / (one - odd / inner)

    backwards = F.array(*[F.lit(float(m)) for m in range(terms, 0, -1)])
    return one / (one - (a + b) * p / (a + one) / F.aggregate(backwards, one, step))


def _lower_limit(x: Column, n: Column, conf: float) -> Column:
    """p with P(X >= x | n, p) = (1 - conf) / 2, for 1 <= x <= n."""
    half, terms = (1.0 - conf) / 2.0, fraction_terms(conf)
    z = NormalDist().inv_cdf(1.0 - half)

    def solve(v):
        a, b = v["a"], v["b"]
        # ln of the prefactor without the deviances, which alone depend on p
        fixed = (F.log(b / (a + b)) + F.log((a + b) / (F.lit(2 * math.pi) * a * b)) / F.lit(2.0)
                 + stirling_error(a + b) - stirling_error(a) - stirling_error(b))
        sd = F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b)  # of the log odds
        return let(F.struct(a.alias("a"), b.alias("b"), fixed.alias("fixed"), (F.log(a / b) - F.lit(0.1) * sd).alias("highest"),
                            (F.log(a / b) - F.lit(z) * sd).alias("start")), iterate)

    def iterate(v):
        a, b = v["a"], v["b"]

        def step(theta, _i):
            def with_shares(t):
                u, w = (a + b) * t["p"] / a - F.lit(1.0), (a + b) * t["q"] / b - F.lit(1.0)
                deviance = a * (u - F.log1p(u)) + b * (w - F.log1p(w))
                return let(F.struct(_beta_fraction(a, b, t["p"], terms).alias("h"), deviance.alias("dev")), moved)

            def moved(t):
                excess = v["fixed"] - t["dev"] + F.log(t["h"]) - F.lit(math.log(half))
                return F.least(theta - excess * t["h"] / a, v["highest"])

            one = F.lit(1.0)
            return let(F.struct((one / (one + F.exp(-theta))).alias("p"), (one / (one + F.exp(theta))).alias("q")), with_shares)

        theta = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), v["start"], step)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-theta))

    return let(F.struct(x.cast("double").alias("a"), (n - x + F.lit(1)).cast("double").alias("b")), solve)


def exact_binomial_ci(x: Column, n: Column, conf: float = 0.95) -> Column:
    """struct(lcl, ucl) of the Clopper-Pearson interval for x successes in n."""
    x = x.cast("bigint")
    n = n.cast("bigint")
    lcl = F.when(n <= 0, None).when(x <= 0, F.lit(0.0)).otherwise(_lower_limit(x, n, conf))
    ucl = F.when(n <= 0, None).when(x >= n, F.lit(1.0)).otherwise(F.lit(1.0) - _lower_limit(n - x, n, conf))
    return F.struct(lcl.alias("lcl"), ucl.alias("ucl"))


def exact_binomial_ci_py(x: int, n: int, conf: float = 0.95) -> tuple[float, float]:
    """Plain-Python twin (same bisection) for unit tests."""
    half = (1.0 - conf) / 2.0

    def pmf(k, p):
        return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                        + k * math.log(p) + (n - k) * math.log(1 - p))

    def bisect(go_up):
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            if go_up(mid):
                lo = mid
            else:
                hi = mid
        return (lo + hi) / 2

    lower = 0.0 if x <= 0 else bisect(lambda p: sum(pmf(k, p) for k in range(x, n + 1)) < half)
    upper = 1.0 if x >= n else bisect(lambda p: sum(pmf(k, p) for k in range(0, x + 1)) > half)
    return lower, upper
