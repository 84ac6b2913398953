"""Importance resampling of documents towards the distribution of target texts.

A text's features are its runs of one to three consecutive words, hashed into a
fixed number of buckets. Both sides count their features per bucket; a bucket's
gain is the logarithm of the ratio of the two smoothed shares. A document's weight
is the sum of gains over its features, and a Gumbel number drawn from its key turns
the heaviest scores into a sample without replacement.

Texts are taken a batch at a time: a batch's texts are joined with a separator that
is no word character, one pass of the pattern finds all words, a search of the word
places in the texts' offsets tells which text each word is from, and features that
reach over a separator are masked before the buckets are counted. Long texts are cut
between words and carry their last two words over, so a task holds ``PIECE`` bytes of
text as words at a time, or one word if that is longer.

Two passes over the texts, no text is shuffled; counts are ``buckets`` numbers a task.
The draw sorts (score, key) by ranges, so no task holds all scores.

Null and empty texts have no features, weight 0, and are never drawn. A null key is
drawn like the text ``null``; it comes after all others among ties. Rows that repeat
a key count each for itself. An empty target or an empty table gives defined results
(smoothed shares; no rows). Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, n_shuffle, slices, texts_as_bytes

BUCKETS = 10_000
LONGEST = 3  # words of a feature
PIECE = 2 << 20  # bytes of text held as words at a time
SEED = 42

#: A word is a run of a-z, 0-9 and everything beyond ASCII, after A-Z are lower-cased.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
IN_WORD = np.array([WORDS.fullmatch(bytes([b])) is not None for b in range(256)])
SEPARATOR = b"\n"


def word_places(joined: bytes) -> np.ndarray:
    """Where each word of the text starts."""
    inside = IN_WORD[np.frombuffer(joined, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return np.flatnonzero(starts)


def features(joined: bytes, offsets: np.ndarray, buckets: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, text of each feature, bucket of each feature) of joined texts.

    ``offsets`` are where the texts begin. Features within the first ``carried``
    words have been counted before, and so have those words."""
    words = WORDS.findall(joined)
    owner = np.searchsorted(offsets, word_places(joined), side="right") - 1
    spaced = [b" " + w for w in words]
    sums, texts, hashed = list(map(crc32, words)), [], []
    for more in range(LONGEST):
        if more:
            sums = list(map(crc32, spaced[more:], sums))  # a feature's checksum goes on from that of its front
        first = max(carried - more, 0)  # features that start here or later have a new last word
        inside = owner[first:len(owner) - more] == owner[first + more:]
        texts.append(owner[first:len(owner) - more][inside])
        hashed.append(np.array(sums[first:], np.int64)[inside] % buckets)
    return owner[carried:], np.concatenate(texts), np.concatenate(hashed)


def pieces(texts: list[bytes | None]) -> Iterator[tuple[bytes, np.ndarray, int, int]]:
    """Joined texts of up to PIECE bytes: (bytes, offsets, place of the first text, words carried over)."""
    held, size, begin = [], 0, 0

    def joined(parts, first, carried=0):
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        return SEPARATOR.join(parts).lower(), offsets, first, carried

    for k, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > PIECE:
            yield joined(held, begin)
            held, size = [], 0
        if not held:
            begin = k
        if len(text) <= PIECE:
            held.append(text)
            size += len(text) + 1
            continue
        at, carry = 0, []
        while at < len(text):
            cut = BETWEEN.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            part = text[at:end]
            yield joined([b" ".join([*carry, part])], k, len(carry))
            carry = (carry + WORDS.findall(part.lower()))[1 - LONGEST:]
            at = end
    if held:
        yield joined(held, begin)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket: ``buckets`` numbers, whatever the table's size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for joined, offsets, _, carried in pieces(texts_as_bytes(batch.column(0))):
                total += np.bincount(features(joined, offsets, buckets, carried)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's smoothed share of a bucket to the source's, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for joined, offsets, first, carried in pieces(texts_as_bytes(batch.column(1))):
                words, owner, bucket = features(joined, offsets, len(gains), carried)
                here = slice(first, first + len(offsets))
                n_words[here] += np.bincount(words, minlength=len(offsets))
                n_features[here] += np.bincount(owner, minlength=len(offsets))
                weight[here] += np.bincount(owner, weights=gains[bucket], minlength=len(offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))],
                                             names=["key", "n_words", "n_features", "weight"])

    return keyed.mapInArrow(weights, f"key {dict(keyed.dtypes)['key']}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number drawn from the key, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, open_to: Column, percent: int) -> DataFrame:
    """``scored`` with ``rank``: the places of the highest scores among the rows that are
    open to the draw, ties to the smaller key; null for rows that are not drawn.

    Rows are sorted by ranges; a row's place is its place in its range and the sizes of
    the ranges before it, of which there are as many as shuffle partitions."""
    order = [F.col("open_").desc(), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    spark = scored.sparkSession
    part = F.spark_partition_id()
    # checkpointed, so that a lost executor cannot deal rows to other ranges than were counted
    placed = cut_lineage(scored.withColumn("open_", open_to).repartitionByRange(n_shuffle(spark), *order).sortWithinPartitions(*order)
                         .select("*", part.alias("part"),
                                 (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("place")))
    sizes = sorted(placed.groupBy("part").agg(F.count("*"), F.count_if("open_")).collect())
    before, total = [], 0
    for p, n, _ in sizes:
        before.append((p, total))
        total += n
    drawn = sum(n for *_, n in sizes) * percent // 100
    starts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "part int, before long"))  # one row a partition
    rank = F.col("before") + F.col("place") + 1
    return placed.join(starts, "part").withColumn("rank", F.when(F.col("open_") & (rank <= drawn), rank)) \
        .select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document.

    ``percent`` of the documents with at least ``least_words`` words are drawn towards
    the texts of ``target``; the others have a null rank."""
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, "text", buckets))
    # written once: sorting by ranges reads its input twice, for the bounds and for the rows
    scored = cut_lineage(weigh(docs, gains, key, text).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)))
    return ranked(scored, F.col("n_words") >= least_words, percent).withColumnRenamed("key", key)


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The documents drawn, with all their columns, in no order."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}_" for k in range(len(names))])
    ids = resample(docs, target, key, **how).filter(F.col("rank").isNotNull()).select(F.col(key).alias("key_")).distinct()
    return plain.join(ids, plain[f"c{names.index(key)}_"].eqNullSafe(F.col("key_")), "left_semi").toDF(*names)
