"""Incremental ingestion of benchmark stats files (S1-S3 as a stream).

The reference rescans its whole stats tree on every run. Here the same scan
is a Structured Streaming file source: each new run directory is read once,
turned into score rows in its micro-batch, appended to a score-row table,
and the (small) scorecard is rebuilt from all score rows. The streaming
checkpoint makes the ingestion exactly-once across restarts; everything
lives under folders the caller provides (on a cluster: shared storage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.benchrows import medhelm_score_rows
from ..operators.scorecard import build_scorecard
from ..sources.files import STAT_RECORD_DDL


def stat_file_stream(spark: SparkSession, root: str, file_name: str = "stats.json",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(STAT_RECORD_DDL)
              .option("multiLine", True)
              .option("recursiveFileLookup", True)
              .option("pathGlobFilter", file_name))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(root).withColumn("file_path", F.col("_metadata.file_path"))


def start_scorecard_stream(spark: SparkSession, root: str, rows_path: str, scorecard_path: str,
                           checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score rows are written per micro-batch (a file is always whole inside
    one batch, so the per-file maximum is final); the scorecard is then
    rewritten from the accumulated rows, which are few (one per run).

    Both writes are idempotent: a batch replayed after a failure overwrites
    its own ``epoch=<id>`` folder instead of appending duplicates, and the
    scorecard is always rebuilt whole."""

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = medhelm_score_rows(batch)
        rows.write.mode("overwrite").parquet(f"{rows_path.rstrip('/')}/epoch={epoch_id}")
        everything = spark.read.parquet(rows_path).drop("epoch")
        build_scorecard(everything).write.mode("overwrite").parquet(scorecard_path)

    writer = (stat_file_stream(spark, root).writeStream.foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
