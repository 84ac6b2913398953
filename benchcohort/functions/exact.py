"""Order-independent aggregates.

Floating-point sums depend on the order rows arrive in, i.e. on how the data
is partitioned. Summing values as fixed-point DECIMAL(38,0) (x scaled by
10^scale and rounded) makes sums exact, so a mean or a standard deviation
is the same on any cluster shape and in the SQL oracle. The 1e-6 default
quantum is far below any reported precision; DECIMAL(38,0) holds sums up to
1e38, i.e. ~1e15 rows of values up to 1e17 at 1e-6 resolution. Squares would
leave it at values of 1e13, so a value is squared in two parts (high * 1e9 +
low) whose products are summed apart: 1e10 rows of values up to 1e17.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 6
PART = 1e9


def fixed(x: Column, scale: int = SCALE) -> Column:
    return F.round(x.cast("double") * F.lit(10.0 ** scale)).cast("decimal(38,0)")


def fixed_sum(x: Column, scale: int = SCALE) -> Column:
    """Exact sum of x at 10^-scale resolution, as DOUBLE."""
    return F.sum(fixed(x, scale)).cast("double") / F.lit(10.0 ** scale)


def fixed_mean(x: Column, scale: int = SCALE) -> Column:
    return F.sum(fixed(x, scale)).cast("double") / F.count(x) / F.lit(10.0 ** scale)


def fixed_moments(x: Column, prefix: str, scale: int = SCALE) -> list[Column]:
    """n, S1 = sum(xs), S2 = sum(xs^2) with xs = x * 10^scale (exact)."""
    xs = fixed(x, scale)
    high = F.floor(F.round(x.cast("double") * F.lit(10.0 ** scale)) / F.lit(PART)).cast("decimal(18,0)")
    low = (xs - high * F.lit(int(PART)).cast("decimal(10,0)")).cast("decimal(12,0)")
    hh, hl, ll = F.sum(high * high), F.sum(high * low), F.sum(low * low)
    # exact while the total fits a DECIMAL(38,0), in double beyond that
    exact = F.try_add(F.try_add(F.try_multiply(hh, F.lit(int(PART * PART)).cast("decimal(19,0)")),
                                F.try_multiply(hl, F.lit(int(2 * PART)).cast("decimal(10,0)"))), ll).cast("double")
    rough = hh.cast("double") * F.lit(PART * PART) + hl.cast("double") * F.lit(2 * PART) + ll.cast("double")
    squares = F.coalesce(exact, rough)
    return [F.count(x).alias(f"{prefix}_n"),
            F.sum(xs).cast("double").alias(f"{prefix}_s1"),
            squares.alias(f"{prefix}_s2")]


def mean_from_moments(n: Column, s1: Column, scale: int = SCALE) -> Column:
    return s1 / n / F.lit(10.0 ** scale)


def var_from_moments(n: Column, s1: Column, s2: Column, scale: int = SCALE) -> Column:
    """Sample variance (n-1 denominator) from exact moments."""
    v = (s2 - (s1 * s1) / n) / (n - F.lit(1))
    return F.when(n > 1, F.greatest(v, F.lit(0.0)) / F.lit(10.0 ** (2 * scale)))


def sd_from_moments(n: Column, s1: Column, s2: Column, scale: int = SCALE) -> Column:
    return F.sqrt(var_from_moments(n, s1, s2, scale))


# ---------------------------------------------------------------- SQL twins
def fixed_sql(x: str, scale: int = SCALE) -> str:
    return f"CAST(round(CAST({x} AS DOUBLE) * {10.0 ** scale}) AS DECIMAL(38,0))"


def fixed_mean_sql(x: str, scale: int = SCALE) -> str:
    return f"(CAST(SUM({fixed_sql(x, scale)}) AS DOUBLE) / COUNT({x}) / {10.0 ** scale})"


def fixed_moments_sql(x: str, prefix: str, scale: int = SCALE) -> str:
    xs = fixed_sql(x, scale)
    return (f"COUNT({x}) AS {prefix}_n, CAST(SUM({xs}) AS DOUBLE) AS {prefix}_s1, "
            f"CAST(SUM({xs} * {xs}) AS DOUBLE) AS {prefix}_s2")


def mean_from_moments_sql(n: str, s1: str, scale: int = SCALE) -> str:
    return f"({s1} / {n} / {10.0 ** scale})"


def var_from_moments_sql(n: str, s1: str, s2: str, scale: int = SCALE) -> str:
    return (f"(CASE WHEN {n} > 1 THEN greatest(({s2} - ({s1} * {s1}) / {n}) / ({n} - 1), 0.0) "
            f"/ {10.0 ** (2 * scale)} END)")


def sd_from_moments_sql(n: str, s1: str, s2: str, scale: int = SCALE) -> str:
    return f"sqrt({var_from_moments_sql(n, s1, s2, scale)})"
