"""Queries of the two classifiers. SQL cannot train them; tests measure them on
the held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import fit_centroids, identify
from .quality import QualityModel, fit_quality, score_quality

THRESHOLD = 0.3


def fold(key: str, n: int) -> Column:
    """Fold of a document by the checksum of its id as text (0 for a null id)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0))


def trained_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """Fitted on the training fold of ``docs``, with labels of that fold only."""
    trusted = table(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (fold("doc_id", 5) != 0))
    return fit_quality(docs.filter(fold("doc_id", 5) != 0), trusted)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, trained_quality(spark, docs, sf_dir))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_centroids(docs.filter(fold("doc_id", 3) != 1)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
