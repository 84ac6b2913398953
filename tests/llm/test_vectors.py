"""Vector searches against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchcohort.llm.annsearch import nearest_neighbours
from benchcohort.llm.knnjoin import exact_scores, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, [rng.gauss(0, 1) for _ in range(12)], 0.0) for k in range(400)]
    out += [(k, [0.5] * 12, 0.0) for k in range(400, 700)]  # one very common vector
    out += [(700, None, 0.0), (710, [float("nan")] * 12, 0.0), (720, [1.0, None] * 6, 0.0), (740, [float("inf")] * 12, 0.0),
            (760, [0.0] * 12, 0.0), (780, [1.0, 2.0], 0.0), (800, [], 0.0), (820, [-0.0] * 12, 0.0)]
    return out + [out[5], out[400], (None, [1.0] * 12, 0.0)]


def usable(rows, zero):
    seen = {}
    for k, v, _ in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            seen[k] = np.r_[np.float32(v).astype(float), np.zeros(12 - len(v))]
    return seen


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_exact_top_k(spark, rows):
    got = listed(exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20))
    vectors = {k: np.floor(64 * v).astype(int) for k, v in usable(rows, zero=True).items()}
    want = {}
    for q in vectors:
        if q % 20 == 0:
            best = sorted((-int(vectors[q] @ v), k) for k, v in vectors.items() if k != q)[:20]
            want[q] = [(k, -s) for s, k in best]
    assert got == want


def test_nearest_neighbours(spark, rows):
    got = listed(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 10))
    vectors = usable(rows, zero=False)
    hits = total = 0
    assert set(got) == {q for q in vectors if q % 20 == 0}
    for q, found in got.items():
        exact = sorted((math.sqrt(((vectors[q] - v) ** 2).sum()), k) for k, v in vectors.items() if k != q)[:10]
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        for k, s in found:
            assert s == pytest.approx(math.sqrt(((vectors[q] - vectors[k]) ** 2).sum()), rel=1e-14, abs=1e-14)
        hits += len({k for k, _ in found} & {k for _, k in exact})
        total += 10
    assert hits / total >= 0.95


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0.0), (20, [0.0, 1.0], 0.0), (3, [1.0, 1.0], 0.0)], SCHEMA)
    assert listed(exact_top_k(few, F.col("vec_id") % 20 == 0, 20)) == {0: [(3, 4096), (20, 0)], 20: [(3, 4096), (0, 0)]}
    assert {k: [x[0] for x in v] for k, v in listed(nearest_neighbours(few, F.col("vec_id") % 20 == 0, 10)).items()} \
        == {0: [3, 20], 20: [3, 0]}
    for search in (exact_top_k, nearest_neighbours):
        assert search(few.limit(0), F.col("vec_id") % 20 == 0, 5).count() == 0
        assert search(few, F.col("vec_id") == 99, 5).count() == 0


def test_scores_beyond_doubles_are_exact():
    q, x = np.array([[2**31 - 1, 3]]), np.array([[2**31 - 3, 1]])
    assert exact_scores(q, x)[0, 0] == (2**31 - 1) * (2**31 - 3) + 3
