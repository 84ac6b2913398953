"""Benchmark scorecard: score rows per (Bench, Model), flags within a bench,
comparison of each improvement with its base model, latest improvement.

All per-unit work (scan, join, aggregate) happens before the scorecard is
formed; everything here runs on aggregated rows (benches x models), so the
windows partitioned by Bench and the small self-join never touch unit-level
data. Flags use windows instead of the reference's join-back-on-max idiom:
one shuffle instead of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import exact_binomial_ci
from ..session import spread
from ..functions.rules import (CANONICAL_MODEL_RULES, IMPROVEMENT_PATTERN, MODEL_CLEAN_RULES,
                               apply_assign_rules, apply_replace_rules)

# ------------------------------------------------------------ names
def clean_model(col: Column, source: str) -> Column:
    """Source-specific clean-up of raw model names."""
    return apply_replace_rules(col, MODEL_CLEAN_RULES.get(source, []))


def improvement_tag(col: Column) -> Column:
    """Trailing improvement tag, e.g. '-prompt2' (P6); '' when absent."""
    return F.regexp_extract(col, IMPROVEMENT_PATTERN, 0)


def canonical_base(col: Column) -> Column:
    """Canonical family name (P5). Names no rule recognises keep their own
    spelling minus the tag, so re-attaching the tag never doubles it."""
    return apply_assign_rules(col, CANONICAL_MODEL_RULES,
                              otherwise=F.regexp_replace(col, IMPROVEMENT_PATTERN, ""))


def with_model_names(df: DataFrame, raw: str = "Model_Orig") -> DataFrame:
    """Adds Improve and Model = trim(canonical || Improve)."""
    return (df.withColumn("Improve", improvement_tag(F.col(raw)))
              .withColumn("Model", F.trim(F.concat(canonical_base(F.col(raw)), F.col("Improve")))))


def improvement_label(improve: Column) -> Column:
    """One-letter family label plus the tag's digits, e.g. '-prompt2' -> 'P2' (P9)."""
    word = F.trim(F.regexp_replace(improve, "-", " "))
    return F.concat(F.upper(F.substring(word, 1, 1)), F.regexp_extract(improve, "[0-9]+$", 0))


def legend_symbol(label: Column) -> Column:
    """Legend entry of a label: its first letter, only for labels without
    digits (numbered variants share their family's symbol) (P9)."""
    return F.when(~label.rlike("[0-9]"), F.substring(label, 1, 1))


def improvement_type(improve: Column) -> Column:
    return F.regexp_replace(improve, "[0-9]+", "")


# ------------------------------------------------------------ scoring
def binomial_scores(units: DataFrame, bench: str, model: str, score: str) -> DataFrame:
    """Per (Bench, Model_Orig): n, x, Center = x/n and the exact 95 % interval.

    Map-side partial aggregation collapses units before the shuffle; the
    interval is computed once per aggregated row.
    """
    agg = (units.groupBy(F.col(bench).alias("Bench"), F.col(model).alias("Model_Orig"))
           .agg(F.count(score).alias("n"), F.sum(score).cast("bigint").alias("x")))
    agg = spread(agg)  # few rows, heavy interval evaluation: use every core
    ci = exact_binomial_ci(F.col("x"), F.col("n"))
    return (agg.withColumn("Center", F.col("x") / F.col("n"))
               .withColumn("_ci", ci)
               .withColumn("L95", F.col("_ci.lcl")).withColumn("U95", F.col("_ci.ucl"))
               .withColumn("limits_not_ci", F.lit(0))
               .drop("_ci"))


# ------------------------------------------------------------ flags
def flag_best_worse(sc: DataFrame) -> DataFrame:
    bench = Window.partitionBy("Bench")
    ordered = (Window.partitionBy("Bench")
               .orderBy(F.col("Center").desc_nulls_last(), F.col("Model"))
               .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    meta = F.when(F.lower("Model").contains("llama"), 1).otherwise(0)
    out = (sc.withColumn("Center_Best", F.max("Center").over(bench))
             .withColumn("_L95_top", F.first("L95").over(ordered))
             .withColumn("Best", F.when(F.col("Center") == F.col("Center_Best"), 1).otherwise(0))
             .withColumn("Worse", F.when(F.col("Center") < F.col("_L95_top"), 1).otherwise(0))
             .withColumn("Meta", meta))
    best_meta = F.max(F.when(F.col("Meta") == 1, F.col("Center"))).over(bench)
    return (out.withColumn("BestMeta", F.when((F.col("Meta") == 1) & (F.col("Center") == best_meta), 1)
                           .otherwise(0))
               .drop("_L95_top"))


# ------------------------------------------------------------ base comparison
def unique_entries(sc: DataFrame) -> DataFrame:
    """``sc``, failing with the key if a (Bench, Model) entry occurs twice.

    Two raw names that clean to one model would multiply in the self-joins."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("Bench", "Model")) > 1
    said = F.concat(F.lit("two scorecard entries for "), F.concat_ws(" / ", "Bench", "Model"))
    return sc.withColumn("_twice", twice).withColumn("Model", F.when(F.col("_twice"), F.raise_error(said))
                                                     .otherwise(F.col("Model"))).drop("_twice")


def compare_to_base(sc: DataFrame) -> DataFrame:
    sc = unique_entries(sc)
    improved = (sc.filter(F.col("Improve") != "")
                  .select("Bench", "Model", "Center", "Improve",
                          F.replace(F.col("Model"), F.col("Improve"), F.lit("")).alias("Base")))
    bases = sc.select("Bench", F.col("Model").alias("Base"), F.col("Center").alias("Center_Base"),
                      F.col("L95").alias("L95_Base"), F.col("U95").alias("U95_Base"))
    progress = (F.when(F.col("Center") > F.col("U95_Base"), "Better")
                 .when(F.col("Center") < F.col("L95_Base"), "Worse")
                 .otherwise("Same"))
    matched = (improved.join(bases, ["Bench", "Base"])
               .select("Bench", "Model", "Base", "Center_Base", "L95_Base", "U95_Base",
                       progress.alias("Progress"), improvement_label(F.col("Improve")).alias("Improve_Label")))
    return (sc.join(matched, ["Bench", "Model"], "left")
              .withColumn("Improve_Type", improvement_type(F.col("Improve"))))


# ------------------------------------------------------------ latest improvement
def mark_latest(sc: DataFrame) -> DataFrame:
    w = Window.partitionBy("Bench", "Base", "Improve_Type")
    latest = F.col("Base").isNotNull() & (F.col("Improve") == F.max("Improve").over(w))
    return sc.withColumn("Improve_Last", F.when(latest, 1).otherwise(0))


def build_scorecard(score_rows: DataFrame, materialize: bool = False) -> DataFrame:
    """score rows (Bench, Model_Orig, n, Center, L95, U95, limits_not_ci) -> full scorecard.

    The scorecard reads its score rows three times (flags, improved rows,
    base rows); ``materialize`` checkpoints the aggregated rows once so the
    unit-level scan and aggregate behind them run a single time."""
    if materialize:
        from ..session import cut_lineage
        score_rows = cut_lineage(score_rows)
    named = with_model_names(score_rows)
    return mark_latest(compare_to_base(flag_best_worse(named)))


def cases_scorecard(cases: DataFrame) -> DataFrame:
    units = cases.withColumn("model_clean", clean_model(F.col("raw_model"), "cases"))
    return build_scorecard(binomial_scores(units, "bench", "model_clean", "score"), materialize=True)
