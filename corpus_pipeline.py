"""Corpus pipeline: quality classifier, near-duplicate removal, substring
removal, source mixing and tokenisation, each stage written as Parquet and
read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchcohort.llm import stages
from benchcohort.llm.common import scratch_path, table

STAGES = [
    ("quality classifier", stages.keep_good),
    ("near duplicates", stages.drop_near_duplicates),
    ("substring dedup", stages.drop_repeated_passages),
    ("source mix", stages.mix_sources),
    ("bpe", stages.encode),
]

#: SQL cannot train the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
