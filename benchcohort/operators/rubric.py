"""Rubric scoring: latest run per model, per-conversation score, and the
three groupings (overall / axis / theme) in one grouping-sets aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scorecard import clean_model
from .stats import checked_broadcast


def latest_run(items: DataFrame, model: str = "model", run: str = "run_id") -> DataFrame:
    """Keep each model's latest run.

    Aggregate-then-join rather than a window partitioned by model: a window
    would put every row of a hot model into one task. The per-model maximum
    (one row per model) is materialised, measured and broadcast, so the item
    table is filtered in place — it is never shuffled for the join. Scores need
    not read the items for this: they are filtered after their aggregate, by
    :func:`latest_scores`.
    """
    latest = cut_lineage(items.groupBy(model).agg(F.max(run).alias(run)))
    return items.join(checked_broadcast(latest), [model, run], "left_semi")


def latest_scores(scores: DataFrame) -> DataFrame:
    """Scores of each model's latest run (J1 after A5 or A6): every run is scored
    in one pass over the items, and the run is chosen on the scores."""
    return latest_run(cut_lineage(scores))


def score_expr(points: str = "points", met: str = "criterion_met"):
    """sum(points * met) / sum(positive points); null when the denominator is
    0 (R's NaN/-Inf) or when any term is null (R's NA propagation) (A5, P14)."""
    num = F.sum(F.col(points) * F.col(met))
    den = F.sum(F.when(F.col(points) > 0, F.col(points)).otherwise(F.lit(0.0)))
    complete = F.count(F.col(points) * F.col(met)) == F.count(F.lit(1))
    return F.when(complete, F.try_divide(num, den))


def case_accuracy(cases: DataFrame, model: str, case: str = "case_id", score: str = "score") -> DataFrame:
    """Share of correct judgements per (model, case); a judgement without a score counts as wrong."""
    correct = F.when(F.col(score).isNull(), 0).otherwise(F.col(score))
    return cases.groupBy(model, case).agg(F.avg(correct).alias("correct"))


def conversation_scores(items: DataFrame) -> DataFrame:
    """One score per (model, run_id, conversation_id)."""
    return (items.groupBy("model", "run_id", "conversation_id")
                 .agg(score_expr().alias("score")))


def grouping_set_scores(items: DataFrame) -> DataFrame:
    """Scores per conversation overall, by axis and by theme, in one pass
    (A6): GROUPING SETS expand each row three ways before the partial
    aggregate, so there is a single shuffle instead of three scans."""
    keys = [F.col("model"), F.col("run_id"), F.col("conversation_id")]
    g = items.groupingSets(
        [keys, keys + [F.col("axis")], keys + [F.col("theme")]],
        "model", "run_id", "conversation_id", "axis", "theme")
    out = g.agg(score_expr().alias("score"),
                F.grouping("axis").alias("_ga"), F.grouping("theme").alias("_gt"))
    grp = (F.when(F.col("_ga") == 0, F.concat(F.lit("axis:"), F.coalesce(F.col("axis"), F.lit("NA"))))
            .when(F.col("_gt") == 0, F.concat(F.lit("theme:"), F.coalesce(F.col("theme"), F.lit("NA"))))
            .otherwise(F.lit(".Overall")))
    return out.select("model", "run_id", grp.alias("grp"), "conversation_id", "score")


def bench_title(grp) -> "F.Column":
    """'HealthBench: Axis: A0' style label."""
    spaced = F.regexp_replace(F.regexp_replace(grp, "_", " "), ":", ": ")
    return F.replace(F.concat(F.lit("HealthBench: "), F.initcap(spaced)), F.lit(".overall"), F.lit(".Overall"))


def cleaned(items: DataFrame) -> DataFrame:
    return items.withColumn("model", clean_model(F.col("model"), "rubric"))
