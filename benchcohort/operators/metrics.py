"""One-vs-rest ROC AUC and PR AUC per class, micro and macro.

Unit rows are first collapsed to (set, target, score) -> (positives,
negatives); running totals over the distinct scores are distributed prefix
sums (range-partitioned), so a class with billions of distinct scores is
spread over many tasks. Ties get half credit (Mann-Whitney).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohort import c
from .stats import prefix_sums


def stack_classes(df: DataFrame, id_col: str, group_col: str, classes: Sequence[str]) -> DataFrame:
    """Wide <class>_true / <class>_pred columns -> long (id, group, target,
    truth, score) (U7); micro pools every (class, row) pair."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(k).alias("target"), c(f"{k}_true").alias("truth"), c(f"{k}_pred").alias("score"))
        for k in classes])).alias("s")
    return df.select(c(id_col).alias("id"), c(group_col).alias("grp"), parts).select("id", "grp", "s.*")


def _counts(long: DataFrame) -> DataFrame:
    per_class = long.groupBy("grp", "target", "score").agg(
        F.sum("truth").cast("bigint").alias("pos"), F.sum(F.lit(1) - F.col("truth")).cast("bigint").alias("neg"))
    micro = per_class.groupBy("grp", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return per_class.unionByName(micro.withColumn("target", F.lit("micro")))


def auroc(long: DataFrame) -> DataFrame:
    """AUC = sum_s pos(s) * (neg below s + neg tied at s / 2) / (P * N); null
    where a class has no positives or no negatives in a set."""
    cnt = prefix_sums(_counts(long), ["grp", "target"], "score", ["neg"])
    cnt = cnt.withColumn("neg_below", F.col("cum_neg") - F.col("neg"))
    credit = F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    per = cnt.groupBy("grp", "target").agg(
        F.try_divide(F.sum(credit), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))
    return _with_macro(per, "auc")


def auprc(long: DataFrame) -> DataFrame:
    """Area under precision-recall, trapezoids over distinct thresholds from
    the highest score down; the first point pairs with its own precision.
    Null for a class without positives.
    The previous point is the running total minus the current counts, so no
    lag across partitions is needed."""
    cnt = prefix_sums(_counts(long), ["grp", "target"], "score", ["pos", "neg"], descending=True)
    tot = cnt.groupBy("grp", "target").agg(F.sum("pos").alias("P"))
    pts = cnt.join(tot, ["grp", "target"])
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    recall = F.try_divide(tp, F.col("P"))
    precision = tp / (tp + fp)
    r_prev = F.try_divide(tp0, F.col("P"))
    p_prev = F.when((tp0 + fp0) > 0, tp0 / (tp0 + fp0)).otherwise(precision)
    area = (recall - r_prev) * (precision + p_prev) / F.lit(2.0)
    per = pts.groupBy("grp", "target").agg(F.sum(area).alias("auprc"))
    return _with_macro(per, "auprc")


def _with_macro(per: DataFrame, metric: str) -> DataFrame:
    macro = (per.filter(F.col("target") != "micro").groupBy("grp")
                .agg(F.avg(metric).alias(metric)).withColumn("target", F.lit("macro")))
    return per.unionByName(macro)
