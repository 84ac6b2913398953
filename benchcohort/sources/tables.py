"""Readers for the driver's Parquet tables.

Every query reads through here so Catalyst sees a plain Parquet scan it can
prune (``ReadSchema``) and push filters into (``PushedFilters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view (for ``spark.sql``)."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
