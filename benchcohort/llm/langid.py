"""Language identification by nearest centroids.

A text becomes a vector of hashed byte trigrams of its lower-cased letters (all
else counts as blank), weighted by 1 + log tf and idf and scaled to length one.
Each language has several centroids, found by spherical k-means; a text gets the
language of the centroid with the largest cosine. Texts that are farther from
their centroid than nearly all training texts of its language are marked as
rejected, so callers can treat them as unknown.

Document frequencies cover all training documents, in one distributed pass.
Centroids are fitted on at most ``FIT_DOCS`` documents a language (those with the
smallest hashes of their ids) and at most ``MOST_LANGUAGES`` languages can be
told apart; the fit fails beyond that rather than leave some out.

Defined results: null texts and texts without any letter are ``und`` with score
0; texts without a known trigram take the first language with score 0; with no
training rows every text is ``und``; repeated rows give repeated rows; empty
tables give none; columns other than those asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_as_bytes

#: Trigram buckets (a power of two), centroids a language, and bounds of the fit.
BUCKETS, CLUSTERS, FIT_DOCS, MOST_LANGUAGES = 4096, 4, 500, 200
#: Share of a language's training texts that its rejection distance keeps.
KEPT_SHARE = 0.995
#: Bytes of text that are turned into vectors at once, and texts at most.
GROUP_BYTES, GROUP_TEXTS = 2_000_000, 512

#: Bytes other than letters become blanks; bytes of longer characters stay.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(texts: pa.Array) -> np.ndarray:
    found = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
    return found.to_numpy(zero_copy_only=False)


def trigram_counts(texts: Sequence[bytes]) -> np.ndarray:
    """Rows of bucket counts; two blanks between texts keep trigrams apart."""
    joined = np.frombuffer((b"  " + b"  ".join(texts) + b"  ").translate(_LETTERS), np.uint8).astype(np.uint32)
    a, b, c = joined[:-2], joined[1:-1], joined[2:]
    code = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (code >> np.uint32(20)).astype(np.int64) % BUCKETS
    keep = (a != 32) | (b != 32) | (c != 32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    if len(texts):
        owner = np.r_[owner, np.full(len(bucket) - len(owner), len(texts) - 1)] if len(owner) < len(bucket) else owner[:len(bucket)]
    at = owner[keep] * BUCKETS + bucket[keep]
    return np.bincount(at, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (zero rows stay zero)."""
    tf = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1)), 0.0).astype(np.float32) * idf.astype(np.float32)
    length = np.sqrt((tf * tf).sum(1, keepdims=True))
    return tf / np.where(length > 0, length, 1.0)


def groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive lower-cased texts of a batch, a few MB at a time."""
    column = texts_as_bytes(pc.utf8_lower(texts))
    start, held, out = 0, 0, []
    for k, t in enumerate(column):
        out.append(t or b"")
        held += len(out[-1])
        if held >= GROUP_BYTES or len(out) >= GROUP_TEXTS or k == len(column) - 1:
            yield start, out
            start, held, out = k + 1, 0, []


def inverse_document_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """Over all of ``docs``: a task hands on one count a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, texts in groups(batch.column(0)):
                df += (trigram_counts(texts) > 0).sum(0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.r_[n, df])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS + 1)
    for r in rows:
        counts[r.bucket + 1] = r.n
    return np.log((1 + counts[0]) / (1 + counts[1:])) + 1


@dataclass
class Centroids:
    """Centroid rows with their languages and rejection limits."""
    idf: np.ndarray
    rows: np.ndarray
    languages: list[str]
    limits: np.ndarray


def spherical_clusters(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids; the start is spread out (each next one the least similar so far)."""
    centres = [vectors.mean(0)]
    while len(centres) < min(k, len(vectors)):
        best = np.max(vectors @ np.array(centres).T, axis=1)
        centres.append(vectors[int(best.argmin())])
    centres = np.array(centres)
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (owner == c).any():
                centres[c] = vectors[owner == c].mean(0)
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = centres / np.where(length > 0, length, 1.0)
    return centres


def fit_centroids(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> Centroids:
    """Fit on the rows of ``docs`` with a label and a letter in the text."""
    train = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    idf = inverse_document_frequencies(train, text)
    sizes = train.groupBy(F.col(label).alias("label_")).agg(F.count("*").alias("size_"))
    if len(sizes.select("label_").limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # places are uniform in [0, 1): the first four samples' worth is enough to rank, in any task
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / 16.0**13
    ids = train.select(F.col(key).alias("id_"), F.col(label).alias("label_"), place.alias("place_")) \
        .join(F.broadcast(sizes), "label_").filter(F.col("place_") * F.col("size_") <= 4 * FIT_DOCS)
    ids = ids.withColumn("rn_", F.row_number().over(W.partitionBy("label_").orderBy("place_", "id_"))) \
        .filter(F.col("rn_") <= FIT_DOCS).select("id_").distinct()
    # at most FIT_DOCS ids for each of at most MOST_LANGUAGES languages, and one text (the least) for each id and label
    chosen = train.select(F.col(key).alias("key_"), F.col(label).alias("label_"), F.col(text).alias("text_")) \
        .join(F.broadcast(ids), F.col("key_").eqNullSafe(F.col("id_"))) \
        .groupBy("id_", "label_").agg(F.min("text_").alias("text_")).select("label_", "text_")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = has_letter(batch.column(1))
            for start, texts in groups(batch.column(1)):
                rows = weighted(trigram_counts(texts), idf)
                ok = letters[start:start + len(texts)] & (rows.any(axis=1))
                names = batch.column(0).slice(start, len(texts)).filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array([r.tobytes() for r in rows[ok].astype(np.float16)], pa.binary())], names=["lang", "v"])

    by_language: dict[str, list[bytes]] = {}
    for r in chosen.mapInArrow(vectors, "lang string, v binary").collect():
        by_language.setdefault(r.lang, []).append(bytes(r.v))
    rows, languages, limits = [], [], []
    for lang in sorted(by_language):
        m = np.frombuffer(b"".join(sorted(by_language[lang])), np.float16).reshape(-1, BUCKETS).astype(np.float32)
        centres = spherical_clusters(m, CLUSTERS)
        limit = float(np.quantile((m @ centres.T).max(1), 1 - KEPT_SHARE))
        rows += list(centres)
        languages += [lang] * len(centres)
        limits += [limit] * len(centres)
    return Centroids(idf, np.array(rows, np.float32).reshape(-1, BUCKETS), languages, np.array(limits))


def identify(docs: DataFrame, model: Centroids, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus lang_pred, score (cosine, 0 to 1) and rejected."""
    picked = docs.select(*keep, text)
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    n_keep = len(keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            n = batch.num_rows
            lang, score, far = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            letters = has_letter(batch.column(n_keep))
            for start, texts in groups(batch.column(n_keep)):
                if not len(names):
                    continue
                ok = letters[start:start + len(texts)]
                cosine = weighted(trigram_counts(texts), model.idf) @ model.rows.T
                best = cosine.argmax(1)
                top = cosine[np.arange(len(best)), best]
                part = slice(start, start + len(texts))
                lang[part] = np.where(ok, names[best], "und")
                score[part] = np.where(ok, np.clip(top, 0, 1), 0.0)
                far[part] = ok & (top < model.limits[best])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(lang.tolist(), pa.string()),
                                              pa.array(score), pa.array(far)], names=schema.names)

    return picked.mapInArrow(predict, schema)
