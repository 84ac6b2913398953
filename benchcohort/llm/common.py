"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import cut_lineage, ensure_checkpoint_dir, scratch_path
from ..sources.tables import table

__all__ = ["cut_few", "cut_lineage", "ensure_checkpoint_dir", "n_shuffle", "scratch_path", "slices", "table",
           "texts_as_bytes"]

#: A word, everywhere in this subpackage: a run of characters that are neither
#: a blank nor U+0009..U+000D. ``bytes.split()`` cuts UTF-8 text at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def n_shuffle(spark: SparkSession) -> int:
    """The cluster's own shuffle width (sized by whoever runs the job)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_few(df: DataFrame) -> DataFrame:
    """Checkpoint of pairs, links or the like, which are few against the texts: one file
    for each core and not for each shuffle partition."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.coalesce(cores) if cores < n_shuffle(df.sparkSession) else df)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task never holds many texts as Python objects.

    After the last one, memory that the allocators keep is given back: a worker lives
    on for tasks of other stages, whose needs would come on top."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
