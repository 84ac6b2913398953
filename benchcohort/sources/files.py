"""File sources and sinks.

Bulk data is read and written by Spark itself; trees of stats files are written
by the executors through the data source of :mod:`.statfiles`. The driver lists
folders and writes single control files through the session's Hadoop FileSystem.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .statfiles import StatFiles

# Schema of one record in a benchmark stats file (explicit: run directories
# contain ':' which breaks schema inference and globbing).
STAT_RECORD_DDL = ("name STRUCT<name: STRING, split: STRING, perturbation: STRUCT<name: STRING, "
                   "robustness: BOOLEAN, fairness: BOOLEAN, computed_on: STRING>>, count BIGINT, sum DOUBLE, "
                   "sum_squared DOUBLE, min DOUBLE, max DOUBLE, mean DOUBLE, variance DOUBLE, stddev DOUBLE")


# ---------------------------------------------------------------- Hadoop FS helpers
def _fs_path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text_file(spark: SparkSession, uri: str, text: str) -> None:
    path, fs = _fs_path(spark, uri)
    out = fs.create(path, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def list_names(spark: SparkSession, uri: str) -> list[str]:
    path, fs = _fs_path(spark, uri)
    if not fs.exists(path):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(path))


# ---------------------------------------------------------------- S1 / S2 / S3
def read_stat_files(spark: SparkSession, root: str, file_name: str = "stats.json") -> DataFrame:
    """Recursive scan of benchmark stats files: each file is a JSON array of
    stat records. ``pathGlobFilter`` on the exact name skips look-alikes
    such as ``instance_stats.json`` (S2)."""
    df = (spark.read.schema(STAT_RECORD_DDL)
          .option("multiLine", True)
          .option("recursiveFileLookup", True)
          .option("pathGlobFilter", file_name)
          .json(root))
    return df.withColumn("file_path", F.col("_metadata.file_path"))


def run_dir(path: Column) -> Column:
    """Name of the directory holding the file."""
    return F.element_at(F.split(path, "/"), -2)


def bench_from_dir(d: Column) -> Column:
    """Benchmark = directory name up to the first ':' (S3)."""
    return F.regexp_replace(d, ":.*$", "")


def model_from_dir(d: Column) -> Column:
    """Model = text after the last ':' and then after the last '_' (S3)."""
    return F.regexp_replace(F.regexp_replace(d, "^.*:", ""), "^.*_", "")


def write_stat_files(spark: SparkSession, records: DataFrame, root: str, bench: str, model: str,
                     provider: str = "local", decoy: bool = True) -> int:
    """Write one ``stats.json`` (a JSON array) per (bench, model) run into
    ``<root>/<bench>:model=<provider>_<model>,model_deployment=<provider>_<model>/``
    and return the number of runs.

    Spark serialises each record and brings a run's records together in order;
    executors stream them into files, which appear under ``root`` when all are
    complete. No record passes through the driver."""
    spark.dataSource.register(StatFiles)
    run = [F.col(bench).alias("_b"), F.col(model).alias("_m")]
    deployment = F.concat(F.lit(f"{provider}_"), F.col("_m"))
    folder = F.concat(F.col("_b"), F.lit(":model="), deployment, F.lit(",model_deployment="), deployment)
    rows = records.select(*run, F.to_json(F.struct("name", "count", "sum", "sum_squared", "min", "max", "mean", "variance", "stddev")).alias("record"))
    rows = rows.select(folder.alias("folder"), "record").repartition("folder").sortWithinPartitions("folder", "record")
    rows.write.format(StatFiles.name()).mode("append").option("root", root).option("decoy", str(decoy).lower()).save()
    return records.select(*run).distinct().count()


# ---------------------------------------------------------------- S4 / S6 / S7
def read_delimited(spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = "\t",
                   header: bool = True, null_value: str = "", rebalance: bool = False) -> DataFrame:
    """Delimited text with header and an explicit schema; source file kept.

    Gzip files are not splittable (one task per file). With ``rebalance``
    the rows are spread over the cluster's parallelism when the input has
    fewer files than that (decided from the file listing, not a job)."""
    df = (spark.read.schema(schema).option("sep", sep).option("header", header)
          .option("nullValue", null_value).csv(paths if isinstance(paths, str) else list(paths))
          .withColumn("source_file", F.col("_metadata.file_path")))
    if rebalance:
        target = spark.sparkContext.defaultParallelism
        if len(df.inputFiles()) < target:
            df = df.repartition(target)
    return df


def source_label(path: Column, short_names: dict[str, str] | None = None) -> Column:
    """Source label from a file name: drop 'data_processed_' and extensions,
    '_' -> ' ', title case, then the caller's abbreviations of providers (S6)."""
    base = F.element_at(F.split(path, "/"), -1)
    folder = F.element_at(F.split(path, "/"), -2)
    name = F.when(base.startswith("part-"), folder).otherwise(base)
    stem = F.regexp_replace(name, r"data_processed_|\.csv|\.gz", "")
    label = F.initcap(F.regexp_replace(stem, "_", " "))
    for long, short in (short_names or {}).items():
        label = F.replace(label, F.lit(long), F.lit(short))
    return label


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Stack sources with different columns; missing columns become null."""
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Land a table as Parquet partitioned by ``by`` (e.g. the cohort by
    index year) so later filters on it prune whole directories.

    Rows of one value come together so that a small value is one file, and
    adaptive execution splits a value whose rows exceed the advisory partition
    size: a hot year is several tasks and several files."""
    df.hint("rebalance", F.col(f"`{by}`")).write.mode("overwrite").partitionBy(by).parquet(path)


# ---------------------------------------------------------------- S5
def newest_snapshot(spark: SparkSession, folder: str, prefix: str) -> tuple[str, DataFrame]:
    """Newest extract by file name (names carry sortable dates): a listing,
    not a scan of every snapshot."""
    names = [n for n in list_names(spark, folder) if n.startswith(prefix)]
    if not names:
        raise FileNotFoundError(f"no {prefix}* under {folder}")
    newest = names[-1]
    return newest, spark.read.parquet(f"{folder.rstrip('/')}/{newest}")


# ---------------------------------------------------------------- S8
def quoted_values(text: Column, quote: str = "'") -> Column:
    """Every quoted value in a line, trimmed, distinct."""
    q = re.escape(quote)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"{q}\\s*(.*?)\\s*{q}"), 1))


def code_lists(lines: DataFrame, text: str = "value", start: str = "^var",
               contains: str = r"rx\(|rx=") -> DataFrame:
    """Variable definitions that list codes (S8): keep lines starting with
    ``start`` whose space-free lower-case form contains ``contains``; the
    name is the text before the first '=' (after the leading keyword), the
    codes are every quoted value (double quotes read as single), distinct.
    Returns (name, code) rows, one per code."""
    squashed = F.regexp_replace(F.lower(F.col(text)), " ", "")
    kept = lines.filter(F.col(text).rlike(start) & squashed.rlike(contains))
    body = F.replace(F.regexp_replace(F.col(text), "^var ", ""), F.lit('"'), F.lit("'"))
    name = F.trim(F.split(body, "=").getItem(0))
    return (kept.select(name.alias("name"), quoted_values(body).alias("codes"))
                .select("name", F.explode("codes").alias("code")))


# ---------------------------------------------------------------- K1 / K2
def write_tsv(df: DataFrame, path: str, first_column: str | None = None, label: str | None = None) -> None:
    """Tab-separated, no quoting, null as empty, header; optionally a row
    label column moved first under a chosen header (K1, K2)."""
    if first_column is not None:
        rest = [c for c in df.columns if c != first_column]
        df = df.select(F.col(first_column).alias(label or first_column), *rest)
    (df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "")
       .option("emptyValue", "").option("quote", "").option("escape", "").csv(path))
