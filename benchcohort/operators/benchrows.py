"""Score rows of the individual benchmark sources (the inputs of
:func:`benchcohort.operators.scorecard.build_scorecard`).

* MedHELM run stats (S1-S3, A4, P13, T3): per stats file the best matching
  statistic; binomial benchmarks get an exact interval on a fixed n (D2),
  0-5 scored ones are rescaled to 0-1 with fixed +-0.025 limits.
* Badge summaries (P2, P12, A2, F1, T3): Green share, and Red reverse
  scored. ``parity=True`` reproduces the reference's choices of n (the
  badge count for the interval, D3; the first provider's total as the
  reported n, D4); the default uses each provider's own total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import exact_binomial_ci
from ..session import spread
from ..sources.files import bench_from_dir, model_from_dir, run_dir
from .scorecard import clean_model
from .stats import best_stat

# Benchmarks scored as proportions (exact interval); the rest are 0-5 scores.
BINOMIAL_BENCHES = ("medhallu", "pubmed_qa")
MEDHELM_N = 1000
RESCALE_MAX = 5.0
RESCALE_HALF_WIDTH = 0.025


def medhelm_score_rows(records: DataFrame, n: int = MEDHELM_N) -> DataFrame:
    """records: stat records with ``file_path`` (from read_stat_files)."""
    best = spread(best_stat(records, ["file_path"]))
    d = run_dir(F.col("file_path"))
    b = bench_from_dir(d)
    is_bin = b.isin(*BINOMIAL_BENCHES)
    val = F.col("val")
    center = F.when(is_bin, val).otherwise(val / F.lit(RESCALE_MAX))
    x = F.bround(val * F.lit(n), 0).cast("bigint")
    ci = exact_binomial_ci(x, F.lit(n))
    return best.select(
        F.concat(F.lit("MedHELM: "), b, F.when(is_bin, F.lit("")).otherwise(F.lit(" (rescale, max=5)"))).alias("Bench"),
        clean_model(model_from_dir(d), "med_helm").alias("Model_Orig"),
        F.lit(n).cast("bigint").alias("n"),
        center.alias("Center"),
        F.when(is_bin, ci["lcl"]).otherwise(center - F.lit(RESCALE_HALF_WIDTH)).alias("L95"),
        F.when(is_bin, ci["ucl"]).otherwise(center + F.lit(RESCALE_HALF_WIDTH)).alias("U95"),
        F.when(is_bin, 0).otherwise(1).alias("limits_not_ci"))


def badge_score_rows(tbl: DataFrame, parity: bool = False) -> DataFrame:
    """tbl: provider, badge, total_count, pct_of_provider (0-100)."""
    provider_total = F.sum("total_count").over(Window.partitionBy("provider"))
    t = tbl.withColumn("_provider_total", provider_total)
    if parity:
        # One n for every row, the total of the provider that sorts first
        # (case-insensitively); the table has one row per (provider, badge).
        first = Window.orderBy(F.lower("provider"), "provider").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        t = t.withColumn("_n_report", F.first("_provider_total").over(first))
    t = t.filter(F.col("badge").isin("Green", "Red"))
    center = F.col("pct_of_provider") / F.lit(100.0)
    center = F.when(F.col("badge") == "Red", F.lit(1.0) - center).otherwise(center)
    n_ci = F.col("total_count") if parity else F.col("_provider_total")
    n_report = F.col("_n_report") if parity else F.col("_provider_total")
    t = t.select(
        F.concat(F.lit("Answered with Evidence: "),
                 F.when(F.col("badge") == "Green", F.lit("01.Green")).otherwise(F.lit("02.Red (reverse scored)"))
                 ).alias("Bench"),
        clean_model(F.col("provider"), "badges").alias("Model_Orig"),
        n_report.cast("bigint").alias("n"), center.alias("Center"), n_ci.cast("bigint").alias("_n_ci"))
    t = spread(t.withColumn("_x", F.bround(F.col("Center") * F.col("_n_ci"), 0).cast("bigint")))
    ci = exact_binomial_ci(F.col("_x"), F.col("_n_ci"))
    return t.select("Bench", "Model_Orig", "n", "_x", "Center", ci["lcl"].alias("L95"), ci["ucl"].alias("U95"),
                    F.lit(None).cast("int").alias("limits_not_ci"))
