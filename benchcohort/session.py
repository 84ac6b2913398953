"""Spark session construction and cluster-safe scratch locations.

Everything that needs a durable place to cut lineage or to land an
intermediate table reads ``spark.checkpoint.dir`` from the running session.
Only in local mode, when that is unset (tests, the bench), do we point it at a
fresh scratch folder of our own; on a cluster an unset folder is an error,
because executors could not see the driver's disk.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # No broadcast from static estimates (file sizes of compressed Parquet,
    # or an explode sized like its input, are not a bound). AQE converts a
    # join to a broadcast only when a side's shuffle output was *measured*
    # under 32 MB; fixed-size dimensions carry an explicit hint.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Let AQE size post-shuffle partitions and split skewed ones.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    # Reliable checkpoints serialise rows with spark.serializer: Kryo is far
    # cheaper than Java serialisation for the cohort-sized checkpoints.
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # Checkpoint files are removed once their DataFrame is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "benchcohort", extra: dict | None = None) -> SparkSession:
    """Local or cluster session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only if unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        try:
            current = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf lookups differ by deploy
            current = None
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="benchcohort-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder (never machine-local
    on a cluster, because the folder comes from the cluster's own setting)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, parallelism: int | None = None) -> DataFrame:
    """Spread aggregated rows over all cores before CPU-heavy per-row work
    such as exact intervals. Without it AQE coalesces a small shuffle output
    into one task and the rows are evaluated one after another. A
    repartition with an explicit count is not coalesced."""
    return df.repartition(parallelism or df.sparkSession.sparkContext.defaultParallelism)


def under_parallel(scan: DataFrame) -> bool:
    """True when a plain table scan has fewer splits than the cluster has
    cores (small files locally; never on large inputs). Only call on scans:
    the split count comes from the file listing, no job runs."""
    return scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism
