"""Plumbing of the two vector searches: vector columns as matrices, identical
vectors collapsed, pivots fitted on a bounded sample, and the block join that
brings query blocks and data blocks of a cell together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(embedding: Column) -> Column:
    """Not null, and no null or non-finite component."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def collapse(vectors: DataFrame, keep: int, query: Column) -> DataFrame:
    """One row per distinct ``vector``: vkey, vector, ids (the ``keep`` smallest
    vec_ids, ascending) and is_query (some row of it is a query).

    A search for ``keep - 1`` neighbours never needs more copies of one vector.
    The window's limit is applied in each task before the shuffle, so a vector
    with a third of all rows moves ``keep`` rows a task."""
    keyed = vectors.select("vec_id", "vector", F.md5(F.to_json(F.struct("vector"))).alias("vkey"))
    first = keyed.dropDuplicates(["vkey", "vec_id"])
    ranked = first.withColumn("rn_", F.row_number().over(W.partitionBy("vkey").orderBy("vec_id")))
    ids = ranked.filter(F.col("rn_") <= keep).groupBy("vkey").agg(
        F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = keyed.filter(query).select("vkey").distinct().withColumn("is_query", F.lit(True))
    return ids.join(asked, "vkey", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))


def matrix(column: pa.Array, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """A list column without nulls as rows, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def fit_pivots(distinct: DataFrame, n: int, most_rows: int, rounds: int = 8) -> np.ndarray:
    """At most ``n`` pivots by k-means on the ``most_rows`` vectors with the
    smallest keys (hashes of the vectors, hence a sample that reruns agree on)."""
    sample = distinct.select("vkey", "vector").orderBy("vkey").limit(most_rows).collect()
    width = max((len(r.vector) for r in sample), default=0)
    data = np.array([list(r.vector) + [0] * (width - len(r.vector)) for r in sample], np.float64).reshape(len(sample), width)
    pivots = data[:n].copy()
    for _ in range(rounds if len(data) > n else 0):
        owner = nearest(data, pivots)[:, 0]
        counts = np.bincount(owner, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, owner, data)
        pivots[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return pivots


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def nearest(a: np.ndarray, pivots: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the ``k`` nearest pivots of each row, nearest first."""
    return np.argsort(squared(a, pivots), axis=1, kind="stable")[:, :k]


def padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def block_join(queries: DataFrame, data: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
               query_rows: int, data_rows: int, few_cells: bool) -> DataFrame:
    """``solve(query block, data block)`` for every pair of blocks within a cell.

    Both sides have ``cell`` and ``vkey``. A cell's rows are cut by hash into
    blocks of about the given numbers of rows, so a hot cell is work for many
    tasks and none holds more than two blocks. ``few_cells``: cells are pivots, so
    their counts are a table of bounded size and broadcast."""
    def blocks(side: DataFrame, rows: int, name: str) -> DataFrame:
        n = F.ceil(F.count("*") / rows).cast("int")
        return side.groupBy("cell").agg(n.alias(name))

    counts = blocks(queries, query_rows, "nq_").join(blocks(data, data_rows, "nd_"), "cell")
    counts = F.broadcast(counts) if few_cells else counts
    own = lambda n: F.pmod(F.xxhash64("vkey"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(counts, "cell").withColumn("qb_", own("nq_")).withColumn("db_", each("nd_")).drop("nq_", "nd_")
    right = data.join(counts, "cell").withColumn("db_", own("nd_")).withColumn("qb_", each("nq_")).drop("nq_", "nd_")
    # both sides may stem from one table: new column identities keep them apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    on = ["cell", "qb_", "db_"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(solve, schema)


def best_of(found: DataFrame, asked: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The ``k`` best of ``found(vkey, vec_id, score)`` for each query row of
    ``asked(query_id, vkey)``, its own id left out.

    ``found`` is cut to k + 1 per distinct query vector before queries that share
    a vector fan out; the limit of the windows applies before their shuffle."""
    top = found.withColumn("rn_", F.row_number().over(W.partitionBy("vkey").orderBy(*order))) \
        .filter(F.col("rn_") <= k + 1)
    lists = top.groupBy("vkey").agg(F.sort_array(F.collect_list(F.struct("rn_", "vec_id", "score"))).alias("top_"))
    out = asked.join(lists, "vkey").select(
        "query_id", F.slice(F.filter("top_", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top_"))
    return out.select("query_id", F.posexplode("top_").alias("pos_", "t_")).select(
        "query_id", (F.col("pos_") + 1).cast("int").alias("rank"), F.col("t_.vec_id").alias("vec_id"),
        F.col("t_.score").alias("score"))

