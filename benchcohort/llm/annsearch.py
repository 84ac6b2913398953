"""Approximate nearest neighbours with randomly rotated one-bit codes.

Index: centroids are fitted on a bounded sample; every vector x belongs to its
nearest centroid c and is stored as the signs of the rotated unit residual
o = R (x - c) / |x - c|, packed to bits, with two correction scalars: |x - c|
and f = <o, s / sqrt(D)>, s the signs. Search: a query probes its nearest
lists. There <o, q'> is estimated as <s / sqrt(D), q'> / f for the rotated unit
residual q' of the query, with the error bound
EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)), which gives an estimate of and a lower
bound on each squared distance. The best by estimate are measured exactly on the
original vectors, then every vector whose lower bound beats the worst of those is
measured too; nothing else is reranked.

Lists and queries meet block by block, so a hot list is work for many tasks.
Equal vectors are one vector with its smallest ids. Codes are cheap to scan, and
vectors without clear clusters lose neighbours to lists that are not probed, so
most lists are probed by default; with clustered vectors more lists and fewer
probes do.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; shorter vectors count as padded with zeros; a row
repeated with its id counts once; ties go to the smaller vec_id; fewer
candidates than k give fewer rows; an empty table gives none; null ids take no
part; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage
from .vectors import best_of, block_join, collapse, fit_pivots, matrix, nearest, padded, usable

#: Rows that centroids are fitted on, lists, and lists probed by a query.
FIT_ROWS, LISTS, PROBES = 16384, 32, 26
#: Width of the error bound in standard deviations, and rows measured at first.
EPSILON, FIRST = 3.0, 48
QUERY_BLOCK, DATA_BLOCK = 4096, 16384
ROTATION_SEED = 20260101

FOUND = T.StructType([T.StructField("vkey", T.StringType()), T.StructField("vec_id", T.LongType()),
                      T.StructField("score", T.DoubleType())])


def rotation(width: int) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def unit_residuals(m: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit residuals and their lengths (a zero residual stays zero)."""
    r = m - centre
    length = np.sqrt((r * r).sum(1))
    return (r / np.where(length > 0, length, 1.0)[:, None]) @ turn.T, length


def encoded(data: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The index: ``data`` plus cell, code (packed bits), length and alignment."""
    schema = T.StructType([*data.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()),
                           T.StructField("length", T.DoubleType()), T.StructField("alignment", T.DoubleType())])
    at = data.columns.index("vector")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = pivots.shape[1]
        turn = rotation(width)
        for batch in batches:
            m = matrix(batch.column(at), width)
            cell = nearest(m, pivots)[:, 0] if len(m) else np.zeros(0, np.int64)
            o, length = unit_residuals(m, pivots[cell], turn)
            codes = [row.tobytes() for row in np.packbits(o > 0, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(codes, pa.binary()), pa.array(length),
                 pa.array(np.abs(o).sum(1) / np.sqrt(width))], names=schema.names)

    return data.mapInArrow(encode, schema)


def probes(queries: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """Query vectors once for each list that they probe."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    at = queries.columns.index("vector")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest(matrix(batch.column(at), pivots.shape[1]), pivots, n).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=schema.names)

    return queries.mapInArrow(probe, schema).select(*queries.columns, F.explode("cells").alias("cell"))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one query to rows, on original values."""
    return np.sqrt(((x - q) ** 2).sum(1))


def solver(k: int, pivots: np.ndarray):
    """The k + 1 nearest of a data block for each query of a query block."""
    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            width = pivots.shape[1]
            turn = rotation(width)
            centre = pivots[right.column("cell")[0].as_py()]
            x, q = matrix(right.column("vector"), width), matrix(left.column("vector"), width)
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            signs = np.unpackbits(code, axis=1, count=width).astype(np.float32) * 2 - 1
            length, f = right.column("length").to_numpy(), right.column("alignment").to_numpy()
            f = np.where(f > 0, f, 1.0)
            error = EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(width - 1, 1))
            own = right.column("ids").to_pylist()
            names = left.column("vkey").to_pylist()
            turned, away = unit_residuals(q, centre, turn)
            for r in range(len(q)):
                inner = signs @ turned[r].astype(np.float32) / np.sqrt(width) / f
                base = length ** 2 + away[r] ** 2
                estimate = base - 2 * length * away[r] * inner
                if len(x) > FIRST:
                    first = np.argpartition(estimate, FIRST)[:FIRST]
                    near = distances(q[r], x[first])
                    worst = np.partition(near, k)[k] if len(near) > k else np.inf
                    low = estimate - 2 * length * away[r] * error
                    low[first] = np.inf
                    more = np.flatnonzero(low <= worst * worst)
                    at = np.r_[first, more]
                    near = np.r_[near, distances(q[r], x[more])]
                else:
                    at, near = np.arange(len(x)), distances(q[r], x)
                top = np.argsort(near, kind="stable")
                edge = near[top[min(k, len(top) - 1)]]
                pairs = sorted((float(near[c]), i) for c in np.flatnonzero(near <= edge).tolist() for i in own[at[c]])[:k + 1]
                keys += [names[r]] * len(pairs)
                ids += [i for _, i in pairs]
                scores += [v for v, _ in pairs]
        return pa.table({"vkey": pa.array(keys, pa.string()), "vec_id": pa.array(ids, pa.int64()),
                         "score": pa.array(scores, pa.float64())})

    return solve


def nearest_neighbours(embeddings: DataFrame, query: Column, k: int, lists: int = LISTS,
                       n_probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score (distance) for every row that ``query`` (on vec_id) picks."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))
                             & F.exists("embedding", lambda x: x != 0))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    distinct = cut_lineage(collapse(vectors, k + 1, query))
    width = distinct.agg(F.max(F.size("vector"))).first()[0] or 0
    pivots = fit_pivots(distinct, lists, FIT_ROWS)
    pivots = padded(pivots, width) if len(pivots) else np.zeros((1, width))
    index = encoded(distinct.select("vkey", "vector", "ids"), pivots)
    asked = probes(distinct.filter("is_query").select("vkey", "vector"), pivots, min(n_probes, len(pivots)))
    found = block_join(asked, index, solver(k, pivots), FOUND, QUERY_BLOCK, DATA_BLOCK, few_cells=True)
    queries = vectors.filter(query).select(F.col("vec_id").alias("query_id"),
                                           F.md5(F.to_json(F.struct("vector"))).alias("vkey")).distinct()
    return best_of(found, queries, k, [F.asc("score"), F.asc("vec_id")])
