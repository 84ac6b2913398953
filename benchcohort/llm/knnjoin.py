"""Exact top-k search by largest integer inner product: a Voronoi kNN join.

Queries are grouped by the nearest of a fixed number of pivots. Data vectors are
not: each is tested by its own norm against every query cell, and no summaries of
data cells exist by which many could be skipped at once. For a query cell with pivot p and radius R (its farthest query), every query q of the
cell and every vector x satisfy

    p.x - R |x|  <=  q.x  <=  p.x + R |x| .

One pass over the data summarises, for each query cell, the k + 1 largest lower
bounds; the smallest of them is a score that k + 1 vectors reach for all queries
of the cell. A vector is replicated to a query cell only if its upper bound
reaches that score, so nothing that could be among the best is left out; the
cells are then solved locally, block by block, and the blocks' bests merged.
Vectors that are equal are one vector with its smallest ids, and queries that
are equal are solved once.

Scores are exact: components are floor(scale * x) as integers; while products
stay below 2^53 double arithmetic is exact, beyond that Python integers are used.

Defined results: vectors that are null or hold null or non-finite components
take no part (neither as query nor as candidate); an empty vector scores 0, a
shorter vector counts as padded with zeros; a row repeated with its id counts
once; ties go to the smaller vec_id; fewer candidates than k give fewer rows;
an empty table gives none; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage
from .vectors import best_of, block_join, collapse, fit_pivots, matrix, nearest, padded, usable

#: Pivots (query cells at most), and the rows that they are fitted on.
PIVOTS, FIT_ROWS = 16, 4096
QUERY_BLOCK, DATA_BLOCK = 4096, 16384
#: Rows of a block that are scored at once.
STRIP = 256
#: Relative slack of the floating-point bounds.
SLACK = 1e-9

FOUND = T.StructType([T.StructField("vkey", T.StringType()), T.StructField("vec_id", T.LongType()),
                      T.StructField("score", T.LongType())])


def cells_and_radii(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Queries with their cell and distance to its pivot."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("reach", T.DoubleType())])
    at = queries.columns.index("vector")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = padded(matrix(batch.column(at)), pivots.shape[1])
            p = padded(pivots, m.shape[1])
            cell = nearest(m, p)[:, 0] if len(m) else np.zeros(0, np.int64)
            reach = np.sqrt(((m - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(reach)],
                                             names=schema.names)

    return queries.mapInArrow(assign, schema)


def lower_bounds(data: DataFrame, pivots: np.ndarray, radii: dict[int, float], k: int) -> dict[int, float]:
    """For each query cell a score that ``k`` vectors are sure to reach (-inf: too few).

    Each task hands on its k largest lower bounds a cell."""
    cells = sorted(radii)
    schema = "cell int, bound double"

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(cells), 0), -np.inf)
        for batch in batches:
            m = padded(matrix(batch.column(0)), pivots.shape[1])
            p = padded(pivots[cells], m.shape[1])
            low = p @ m.T - np.array([radii[c] for c in cells])[:, None] * np.sqrt((m * m).sum(1))
            best = np.concatenate([best, low], axis=1)
            if best.shape[1] > k:
                best = -np.partition(-best, k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells, best.shape[1]), pa.int32()), pa.array(best.ravel())],
                                         names=["cell", "bound"])

    found = data.select("vector").mapInArrow(bound, schema)
    ranked = found.withColumn("rn_", F.row_number().over(W.partitionBy("cell").orderBy(F.desc("bound"))))
    rows = ranked.filter(F.col("rn_") == k).select("cell", "bound").collect()  # one row per cell at most
    return {c: -np.inf for c in cells} | {r.cell: r.bound for r in rows}


def replicated(data: DataFrame, pivots: np.ndarray, radii: dict[int, float], needed: dict[int, float]) -> DataFrame:
    """Data rows once for each query cell that may need them."""
    schema = T.StructType([*data.schema.fields, T.StructField("cell", T.IntegerType())])
    at = data.columns.index("vector")
    cells = sorted(radii)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = padded(matrix(batch.column(at)), pivots.shape[1])
            norm = np.sqrt((m * m).sum(1))
            for c in cells:
                p = padded(pivots[c:c + 1], m.shape[1])[0]
                high = m @ p + radii[c] * norm
                slack = SLACK * (np.abs(m) @ np.abs(p) + radii[c] * norm + 1)
                rows = batch.filter(pa.array(high + slack >= needed[c] - SLACK * abs(needed[c])
                                             if np.isfinite(needed[c]) else np.ones(len(m), bool)))
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, c), pa.int32())],
                                                     names=schema.names)

    return data.mapInArrow(spread, schema)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact at any size that fits a long."""
    width = max(q.shape[1], x.shape[1])
    q, x = padded(q, width), padded(x, width)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1) < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return (q.astype(object) @ x.T.astype(object)).astype(np.int64)


def solver(k: int):
    """The k + 1 best of a data block for each query of a query block."""
    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        names = left.column("vkey").to_pylist()
        if left.num_rows and right.num_rows:
            q, x = matrix(left.column("vector"), dtype=np.int64), matrix(right.column("vector"), dtype=np.int64)
            own = right.column("ids").to_pylist()
            smallest = np.array([i[0] for i in own], np.int64)
            for a in range(0, len(q), STRIP):
                s = exact_scores(q[a:a + STRIP], x)
                edge = -np.partition(-s, k, axis=1)[:, k] if s.shape[1] > k + 1 else s.min(axis=1)
                for r in range(len(s)):
                    at = np.flatnonzero(s[r] >= edge[r])
                    at = at[np.lexsort((smallest[at], -s[r][at]))][:k + 1]
                    pairs = sorted((-int(s[r, c]), i) for c in at.tolist() for i in own[c])[:k + 1]
                    keys += [names[a + r]] * len(pairs)
                    ids += [i for _, i in pairs]
                    scores += [-v for v, _ in pairs]
        return pa.table({"vkey": pa.array(keys, pa.string()), "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.int64())})

    return solve


def quantised(embeddings: DataFrame, scale: float) -> DataFrame:
    """vec_id and the vector of floor(scale * x) for all usable rows."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("vector"))


def exact_top_k(embeddings: DataFrame, query: Column, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for every row that ``query`` (on vec_id) picks."""
    vectors = quantised(embeddings, scale)
    distinct = cut_lineage(collapse(vectors, k + 1, query))
    pivots = fit_pivots(distinct, PIVOTS, FIT_ROWS)
    asked = cells_and_radii(distinct.filter("is_query").select("vkey", "vector"), pivots)
    radii = {r.cell: r.reach * (1 + SLACK) for r in asked.groupBy("cell").agg(F.max("reach").alias("reach")).collect()}
    data = distinct.select("vkey", "vector", "ids")
    needed = lower_bounds(data, pivots, radii, k + 1)
    found = block_join(asked.select("cell", "vkey", "vector"), replicated(data, pivots, radii, needed), solver(k), FOUND,
                       QUERY_BLOCK, DATA_BLOCK, few_cells=True)
    rows = vectors.filter(query).select(F.col("vec_id").alias("query_id"),
                                        F.md5(F.to_json(F.struct("vector"))).alias("vkey")).distinct()
    return best_of(found, rows, k, [F.desc("score"), F.asc("vec_id")])
