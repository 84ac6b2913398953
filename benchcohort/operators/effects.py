"""Treatment-effect estimates from aggregates.

* ``ols_factor`` — lm(Y ~ W) for a single factor is a difference in group
  means; coefficients, pooled sigma, standard errors, t and R^2 all follow
  from per-group (n, sum, sum of squares).
* ``aipw_stratified`` — doubly robust ATE with saturated nuisance models on
  discrete covariate strata X: mu_k(x) and e_k(x) are cell means/shares.
  Because sum over a cell of (Y - mu_k) is 0, the mean of
  Gamma_k - Gamma_ref and its variance reduce to per-(x, arm) moments, so
  the estimator needs one grouped aggregate — no per-row pass.
* ``propensity_histogram`` — e_k(x) weighted by cell sizes, in 20 bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import fixed_moments
from .cohort import c


def ols_factor(df: DataFrame, y: str, w: str, scale: int = 6) -> DataFrame:
    """Rows: term, estimate, std_error, t_value, plus n and r_squared."""
    d = df.filter(c(y).isNotNull() & c(w).isNotNull())
    g = d.groupBy(c(w).alias("level")).agg(*fixed_moments(c(y), "m", scale))
    q = float(10 ** scale)
    g = g.select("level", F.col("m_n").alias("n"), (F.col("m_s1") / F.col("m_n") / q).alias("mean"),
                 ((F.col("m_s2") - F.col("m_s1") * F.col("m_s1") / F.col("m_n")) / (q * q)).alias("ss"),
                 (F.col("m_s1") / q).alias("s1"), (F.col("m_s2") / (q * q)).alias("s2"))
    # One row per level (bounded by the number of levels): window totals
    # and the alphabetical reference level, no join.
    every = Window.partitionBy()
    ordered = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = (g.withColumn("n_tot", F.sum("n").over(every)).withColumn("k_tot", F.count(F.lit(1)).over(every))
          .withColumn("ssw", F.sum("ss").over(every)).withColumn("tot_s1", F.sum("s1").over(every))
          .withColumn("tot_s2", F.sum("s2").over(every))
          .withColumn("ref_level", F.first("level").over(ordered))
          .withColumn("n_ref", F.first("n").over(ordered))
          .withColumn("mean_ref", F.first("mean").over(ordered)))
    # no residual freedom or a constant outcome: null instead of a division by zero
    sigma = F.sqrt(F.try_divide(F.col("ssw"), F.col("n_tot") - F.col("k_tot")))
    sst = F.col("tot_s2") - F.col("tot_s1") * F.col("tot_s1") / F.col("n_tot")
    is_ref = F.col("level") == F.col("ref_level")
    est = F.when(is_ref, F.col("mean_ref")).otherwise(F.col("mean") - F.col("mean_ref"))
    se = F.when(is_ref, sigma / F.sqrt(F.col("n_ref").cast("double"))).otherwise(
        sigma * F.sqrt(F.lit(1.0) / F.col("n") + F.lit(1.0) / F.col("n_ref")))
    term = F.when(is_ref, F.lit("(Intercept)")).otherwise(F.concat(F.lit("W"), F.col("level")))
    return j.select(term.alias("term"), est.alias("estimate"), se.alias("std_error"),
                    F.try_divide(est, se).alias("t_value"), F.col("n_tot").alias("n_obs"),
                    (F.lit(1.0) - F.try_divide(F.col("ssw"), sst)).alias("r_squared"))


def cell_moments(df: DataFrame, y: str, w: str, strata: Sequence[str]) -> DataFrame:
    """Per (stratum, arm): n, sum Y, sum Y^2 — the only pass over the data."""
    d = df.filter(c(y).isNotNull() & c(w).isNotNull())
    return d.groupBy(*[c(s).alias(s) for s in strata], c(w).alias("arm")).agg(
        F.count(F.lit(1)).alias("n_xk"), F.sum(c(y).cast("double")).alias("sy"),
        F.sum((c(y) * c(y)).cast("double")).alias("syy"))


def aipw_stratified(df: DataFrame, y: str, w: str, strata: Sequence[str], ref: str | None = None) -> DataFrame:
    """ATE of each arm against ``ref`` (default: first arm alphabetically).

    Each contrast takes the strata that hold its arm and the reference; in
    others mu_k(x) or mu_ref(x) cannot be estimated. Per arm: ``n`` rows and
    ``n_strata`` strata kept, ``n_dropped`` and ``strata_dropped`` left out. An
    arm that shares no stratum with the reference has a null estimate."""
    cells = cell_moments(df, y, w, strata)
    # The reference arm and the totals are scalar subqueries over the
    # aggregated cells.
    ref_arm = F.lit(ref) if ref is not None else cells.select(F.min("arm")).scalar()
    all_rows = cells.select(F.sum("n_xk")).scalar()
    all_strata = cells.select(*strata).distinct().select(F.count(F.lit(1))).scalar()
    sx = Window.partitionBy(*strata)
    cells = (cells.withColumn("_ref", ref_arm)
                  .withColumn("n_x", F.sum("n_xk").over(sx))
                  .withColumn("mu", F.col("sy") / F.col("n_xk"))
                  .withColumn("e", F.col("n_xk") / F.col("n_x"))
                  .withColumn("ss", F.col("syy") - F.col("sy") * F.col("sy") / F.col("n_xk")))
    r = cells.filter(F.col("arm") == F.col("_ref")).select(*strata, F.col("mu").alias("mu_ref"),
                                                            F.col("e").alias("e_ref"), F.col("ss").alias("ss_ref"))
    k = cells.filter(F.col("arm") != F.col("_ref")).join(r, list(strata), "left")
    delta = F.col("mu") - F.col("mu_ref")
    sum_d = F.col("n_x") * delta
    sum_d2 = (F.col("n_x") * delta * delta + F.col("ss") / (F.col("e") * F.col("e"))
              + F.col("ss_ref") / (F.col("e_ref") * F.col("e_ref")))
    per_arm = k.groupBy("arm", "_ref").agg(
        F.coalesce(F.sum(F.when(F.col("mu_ref").isNotNull(), F.col("n_x"))), F.lit(0)).alias("n"),
        F.count("mu_ref").alias("n_strata"), F.sum(sum_d).alias("sd1"), F.sum(sum_d2).alias("sd2"))
    ate = F.try_divide(F.col("sd1"), F.col("n"))
    var = F.try_divide(F.col("sd2") - F.col("n") * ate * ate, F.col("n") - F.lit(1))
    return per_arm.select("arm", F.col("_ref").alias("reference"), ate.alias("estimate"),
                          F.sqrt(F.try_divide(var, F.col("n"))).alias("std_err"), "n", "n_strata",
                          (all_rows - F.col("n")).alias("n_dropped"),
                          (all_strata - F.col("n_strata")).alias("strata_dropped"))


def propensity_histogram(df: DataFrame, w: str, strata: Sequence[str], bins: int = 20) -> DataFrame:
    """Every row contributes e_k(x) for every arm k; counts per (arm, bin)."""
    cells = df.filter(c(w).isNotNull()).groupBy(*[c(s).alias(s) for s in strata], c(w).alias("arm")).agg(
        F.count(F.lit(1)).alias("n_xk"))
    sx = Window.partitionBy(*strata)
    cells = cells.withColumn("n_x", F.sum("n_xk").over(sx)).withColumn("e", F.col("n_xk") / F.col("n_x"))
    b = F.least(F.floor(F.col("e") * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return (cells.groupBy("arm", b.alias("bin"))
                 .agg(F.sum("n_x").alias("n_rows"), F.min("e").alias("e_min"), F.max("e").alias("e_max")))
