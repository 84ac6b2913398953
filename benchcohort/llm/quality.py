"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text are told apart without trusting any
negative: a logistic score is fitted by minimising the non-negative unbiased
risk  pi E_P[l(+)] + max(0, E_U[l(-)] - pi E_P[l(-)]), where l is the logistic
loss and pi the share of positives among the unlabelled. The prior pi is
estimated from the data: over the sets {score > t} of a first positive-versus-
unlabelled fit, the smallest ratio of the unlabelled to the positive share, both
measured on documents that the first fit has not seen.

A text is described by what does not depend on its language: shares of pairs of
adjacent character classes, how far words, adjacent words and lines repeat, and
lengths. Means and scales of these, and the unlabelled shares that the prior rests
on, are counted over all documents, a pass each. Only the gradients use samples, of
at most ``FIT_POSITIVE`` trusted and ``FIT_UNLABELLED`` unlabelled documents (those
with the smallest hashes of their ids). Scoring is one more pass over whole texts;
nothing is shuffled but sums.

Defined results: a null text is scored as an empty one; with fewer than two trusted
or two unlabelled documents there is nothing to hold a fit against, and every score
is 0.5; of rows that share an id one is fitted on (the least text) and each is
scored; rows without an id count in the statistics; an empty table gives none;
columns that are not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_as_bytes

#: Bounds of the samples that the model is fitted on.
FIT_POSITIVE, FIT_UNLABELLED = 6000, 12000
#: Bytes and texts that are described at once.
GROUP_BYTES, GROUP_TEXTS = 1_000_000, 512

#: Character classes: bytes that are alike for this purpose (all others are class 0).
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".,",
           b"!?", b";:", b"'\"`", b"()[]{}", b"<>", b"/\\|", b"-_=+~", b"#$%&*@^")
N_CLASSES = len(CLASSES) + 2  # and the bytes of characters beyond ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate(CLASSES):
    _CLASS[list(_members)] = _k + 1
_CLASS[128:] = N_CLASSES - 1
N_FEATURES = N_CLASSES * N_CLASSES + 6


def repetition(text: bytes) -> list[float]:
    words = text.split()
    lines = text.split(b"\n")
    n = len(words)
    same = sum(map(eq, words, words[1:]))
    return [1 - len(set(words)) / n if n else 0.0, same / n if n else 0.0, 1 - len(set(lines)) / len(lines),
            np.log1p(n), len(text) / n / 10 if n else 0.0, np.log1p(n / len(lines))]


def describe(texts: Sequence[bytes]) -> np.ndarray:
    """One row of features for each text."""
    n = len(texts)
    joined = _CLASS[np.frombuffer(b" ".join([*texts, b""]), np.uint8)].astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(n), sizes)[:-1] if n else np.zeros(0, np.int64)
    pair = joined[:-1] * N_CLASSES + joined[1:]
    inside = np.ones(len(pair), bool)
    ends = np.cumsum(sizes) - 1
    inside[ends[:-1]] = False  # pairs that begin at the blank between two texts
    square = N_CLASSES * N_CLASSES
    counts = np.bincount(owner[inside] * square + pair[inside], minlength=n * square).reshape(n, square)
    shares = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return np.concatenate([shares, np.array([repetition(t) for t in texts]).reshape(n, 6)], axis=1).astype(np.float32)


def described(texts: pa.Array) -> np.ndarray:
    column = [t or b"" for t in texts_as_bytes(texts)]
    out, start, held = [np.zeros((0, N_FEATURES), np.float32)], 0, 0
    for k, t in enumerate(column):
        held += len(t)
        if held >= GROUP_BYTES or k - start + 1 >= GROUP_TEXTS or k == len(column) - 1:
            out.append(describe(column[start:k + 1]))
            start, held = k + 1, 0
    return np.concatenate(out)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def losses(theta: np.ndarray, x: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Mean losses of rows taken as positive and as negative, and their derivatives by the rows' scores."""
    z = x @ theta[:-1] + theta[-1]
    s = sigmoid(z)
    return np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean(), (s - 1) / len(x), s / len(x)


def pu_risk(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk."""
    p_plus, p_minus, *_ = losses(theta, p)
    return prior * p_plus + max(0.0, losses(theta, u)[1] - prior * p_minus)


def pu_gradient(theta: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """Direction of descent: the gradient of the risk, or, where the estimated negative risk falls
    below zero, of what pushes it back up. Without a prior, of the plain P-versus-U loss."""
    p_plus, p_minus, as_plus, as_minus = losses(theta, p)
    _, u_minus, _, u_as_minus = losses(theta, u)
    if prior is None:
        dp, du = as_plus, u_as_minus
    elif u_minus - prior * p_minus >= 0:
        dp, du = prior * (as_plus - as_minus), u_as_minus
    else:
        dp, du = prior * as_minus, -u_as_minus
    return np.r_[p.T @ dp + u.T @ du, dp.sum() + du.sum()]


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, decay: float = 1e-3) -> np.ndarray:
    """Weights and bias by Adam, with a small decay of the weights."""
    theta = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = pu_gradient(theta, p, u, prior) + decay * np.r_[theta[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.03 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta


def cuts_of(scores: np.ndarray) -> np.ndarray:
    """Scores that 30 % or more of the positives reach."""
    return np.quantile(scores, np.linspace(0.0, 0.7, 29))


def reaching(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many scores reach each cut."""
    return len(scores) - np.searchsorted(np.sort(scores), cuts)


def prior_of(in_p: np.ndarray, in_u: np.ndarray) -> float:
    """Share of positives among the unlabelled, from the shares that reach each cut."""
    return float(np.clip((in_u / np.maximum(in_p, 1e-12)).min(), 0.05, 0.98))


def totals(docs: DataFrame, text: str, of, names: str) -> np.ndarray:
    """``of(features)`` (one row of numbers for any rows of features) added up over all
    documents: each task adds up its own, and Spark the tasks', place by place."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of(np.zeros((0, N_FEATURES)))
        for batch in slices(batches):
            total = total + of(described(batch.column(0)).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", names])

    added = docs.select(text).mapInArrow(work, f"place long, {names} double").groupBy("place").agg(F.sum(names).alias(names))
    rows = sorted(added.collect())
    return np.array([r[1] for r in rows]) if rows else of(np.zeros((0, N_FEATURES)))


def moments(x: np.ndarray) -> np.ndarray:
    return np.r_[float(len(x)), x.sum(0), (x * x).sum(0)]


def fit_quality(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on ``docs``; ``positives`` has the keys of its trusted documents."""
    ids = docs.select(F.col(key).alias("id_")).dropna()
    place_ids = place_of(ids)
    trusted = place_ids.join(positives.select(F.col(key).alias("id_")).distinct(), "id_", "left_semi")
    chosen = trusted.orderBy("place_", "id_").limit(FIT_POSITIVE).select("id_", F.lit(1).alias("trusted")).unionByName(
        place_ids.orderBy("place_", "id_").limit(FIT_UNLABELLED).select("id_", F.lit(0).alias("trusted")))
    # FIT_POSITIVE + FIT_UNLABELLED ids at most, and one text of each
    sample = docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).join(F.broadcast(chosen), "id_") \
        .groupBy("id_", "trusted").agg(F.min("text_").alias("text_"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [r.tobytes() for r in described(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows, pa.binary())],
                                             names=["id", "trusted", "v"])

    rows = sample.mapInArrow(features, "id string, trusted int, v binary").collect()
    rows.sort(key=lambda r: (r.trusted, r.id))
    read = lambda flag: np.frombuffer(b"".join(bytes(r.v) for r in rows if r.trusted == flag),
                                      np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    p, u = read(1), read(0)
    if len(p) < 2 or len(u) < 2:
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    n, *sums = totals(docs, text, moments, "moment")
    mean, squares = np.array(sums).reshape(2, N_FEATURES) / n
    # rounded, so that the order of the sums does not matter
    mean, scale = mean.round(9), (np.sqrt(np.maximum(squares - mean * mean, 0)) + 1e-3).round(9)
    scaled = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = scaled(p), scaled(u)
    first = descend(p[::2], u[::2], None, 150)
    scores = lambda x: x @ first[:-1] + first[-1]
    cuts = cuts_of(scores(p[1::2]))
    # all documents but those of the first fit
    reach = totals(docs, text, lambda x: np.r_[float(len(x)), reaching(scores(scaled(x)), cuts)], "reach") \
        - np.r_[float(len(u[::2])), reaching(scores(u[::2]), cuts)]
    prior = prior_of(reaching(scores(p[1::2]), cuts) / len(p[1::2]), np.maximum(reach[1:], 0) / max(reach[0], 1))
    theta = descend(p, u, prior, 400)
    return QualityModel(mean, scale, theta[:-1], float(theta[-1]), prior)


def place_of(ids: DataFrame) -> DataFrame:
    """Ids with a place from a hash, in which samples are drawn."""
    return ids.distinct().withColumn("place_", F.md5(F.concat(F.lit("fit:"), F.col("id_").cast("string"))))


def score_quality(docs: DataFrame, model: QualityModel, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus score (0 to 1)."""
    picked = docs.select(*keep, text)
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    n_keep = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(described(batch.column(n_keep)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(scores)], names=schema.names)

    return picked.mapInArrow(score, schema)


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = model.score(described(batch.column(at)).astype(np.float64))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)
