"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document. Its minimiser is the
smallest hash among its runs of ``MINIMISER`` words, and consecutive windows that
share their minimiser form a super-k-mer, which travels as one packed string to
the bucket of its minimiser. Equal windows have equal minimisers, so a bucket
sees every occurrence of its windows; it sorts them, compares neighbours word by
word and knows the smallest document of each. A word goes when a window over it
also starts in a document with a smaller id.

How the work is spread. Documents are dealt into blocks by a hash of their id;
this shuffle of the texts is used twice. A block packs its super-k-mers, each
distinct string once with its smallest and largest document, into one compressed
parcel a bucket, so however many copies a passage has, a bucket receives it at
most once a block. Buckets answer with the first documents of those strings
that hold a repeated window, and each block applies the answers to its own texts
in a cogroup. Minimisers that occur in many different contexts (a common line)
would fill one bucket: a first pass counts minimisers by slot over all texts, and
in slots that hold more than ``HOT_SHARE`` of a bucket's share every window
travels by itself to a bucket of its own hash, which is as exact.

Defined results: null and empty texts have no words; texts shorter than a window
lose nothing; rows that share a doc_id are separate rows of one document and
never remove from each other; rows with a null doc_id are returned as they are
and remove nothing; an empty table gives no rows; other columns pass through
only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import n_shuffle, slices, texts_as_bytes

#: Words of a window and of the runs that its minimiser is chosen from.
WINDOW, MINIMISER = 13, 3
#: Slots in which minimisers are counted, and the share of a bucket that makes one hot.
SLOTS, HOT_SHARE = 1 << 16, 0.25
#: Words whose hashes a worker keeps, strings that a block holds before it sends
#: them off, and words that are handled at once.
HASHES, HELD_STRINGS, GROUP_WORDS = 100_000, 100_000, 100_000

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, kept for a worker's common words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < HASHES:
            self[word] = value
        return value


_HASHES = WordHashes()


def minimisers(texts: Sequence[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All words, and for each window its first word's place, its text and its minimiser."""
    words = [w for t in texts for w in t]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(words) < WINDOW:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    run = h
    for k in range(1, MINIMISER):
        run = scrambled((run[:-1] * _MIX1) ^ (h[k:] * _MIX3))
    span = WINDOW - MINIMISER + 1
    least = run[:len(run) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, run[k:len(run) - span + 1 + k], out=least)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(least)]
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[owner])
    return words, at, owner[at], least[at]


def runs(at: np.ndarray, owner: np.ndarray, least: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: indices of their first windows, window counts, and whether hot."""
    is_hot = hot[(least >> np.uint64(48)).astype(np.int64)]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | is_hot[1:]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(at)]), is_hot[first]


def grouped(texts: Sequence[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Consecutive texts as words, about ``GROUP_WORDS`` words at a time."""
    out: list[list[bytes]] = []
    start = held = 0
    for k, t in enumerate(texts):
        out.append(t.split() if t else [])
        held += len(out[-1])
        if held >= GROUP_WORDS or k == len(texts) - 1:
            yield start, out
            start, held, out = k + 1, 0, []


def hot_slots(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Which slots would fill more than ``HOT_SHARE`` of a bucket, counted over all texts."""
    cold = np.zeros(SLOTS, bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            for _, texts in grouped(texts_as_bytes(batch.column(0))):
                _, at, owner, least = minimisers(texts)
                first, _, _ = runs(at, owner, least, cold)
                n += np.bincount((least[first] >> np.uint64(48)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[slot])], names=["slot", "n"])

    got = docs.select(text).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS, np.int64)  # SLOTS rows at most
    n[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return n > HOT_SHARE * n.sum() / buckets


# -- parcels: strings with their smallest and largest document, compressed ------
def parcel(strings: list[bytes], lo: np.ndarray, hi: np.ndarray) -> bytes:
    sizes = np.array([len(s) for s in strings], np.int32)
    raw = b"".join([np.int64(len(strings)).tobytes(), sizes.tobytes(), lo.tobytes(), hi.tobytes(), *strings])
    return zstandard.compress(raw, 6)


def unparcel(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int32, n, 8)
    lo = np.frombuffer(raw, np.int64, n, 8 + 4 * n)
    hi = np.frombuffer(raw, np.int64, n, 8 + 12 * n)
    return sizes, lo, hi, raw[8 + 20 * n:]


def pack_block(hot: np.ndarray, buckets: int, id_at: int, text_at: int):
    """A block's distinct super-k-mers as one parcel a bucket."""
    def pack(table: pa.Table) -> pa.Table:
        out_bucket, out_data = [], []
        place: dict[bytes, int] = {}
        lo, hi, route = [], [], []

        def send() -> None:
            if not place:
                return
            where = np.array(route, np.uint64) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            strings, a, b = list(place), np.array(lo, np.int64), np.array(hi, np.int64)
            for part in np.split(order, cuts):
                out_bucket.append(int(where[part[0]]))
                out_data.append(parcel([strings[k] for k in part.tolist()], a[part], b[part]))
            place.clear(), lo.clear(), hi.clear(), route.clear()

        ids = table.column(id_at).to_pylist()
        for start, texts in grouped(texts_as_bytes(table.column(text_at))):
            texts = [t if ids[start + k] is not None else [] for k, t in enumerate(texts)]
            words, at, owner, least = minimisers(texts)
            first, n, is_hot = runs(at, owner, least, hot)
            begin = at[first]
            mixed = scrambled(least[first] * _MIX3)
            for p, q, o, r, own in zip(begin.tolist(), (begin + n + WINDOW - 1).tolist(), owner[first].tolist(),
                                       mixed.tolist(), is_hot.tolist()):
                s = b" ".join(words[p:q])
                d = ids[start + o]
                k = place.get(s)
                if k is None:
                    place[s] = len(lo)
                    lo.append(d)
                    hi.append(d)
                    route.append(xxhash.xxh3_64_intdigest(s) if own else r)
                elif d < lo[k]:
                    lo[k] = d
                elif d > hi[k]:
                    hi[k] = d
            if len(place) > HELD_STRINGS:
                send()
        send()
        block = table.column("block_")[0].as_py() if table.num_rows else 0
        return pa.table({"bucket_": pa.array(out_bucket, pa.int32()),
                         "block_": pa.array([block] * len(out_bucket), pa.int32()), "data": pa.array(out_data, pa.binary())})

    return pack


def first_documents(ids: np.ndarray, begin: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For windows at ``begin`` (word numbers in ``ids``) the smallest ``lo`` of all equal windows.

    Windows are sorted by a hash; equal neighbours are then compared word by
    word, and if a hash ever stands for two windows all are sorted by words."""
    h = np.zeros(len(begin), np.uint64)
    word = scrambled((ids.astype(np.uint64) + np.uint64(1)) * _MIX1)
    for k in range(WINDOW):
        h = h * _MIX2 + word[begin + k]
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    pairs = np.flatnonzero(same)
    a, b = begin[order[pairs]], begin[order[pairs + 1]]
    if any((ids[a + k] != ids[b + k]).any() for k in range(WINDOW)):
        order = np.lexsort([ids[begin + k] for k in range(WINDOW)])
        same = np.logical_and.reduce([ids[begin[order[1:]] + k] == ids[begin[order[:-1]] + k] for k in range(WINDOW)])
    starts = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(lo[order], starts)
    out = np.empty(len(begin), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
    return out


def solve_bucket(table: pa.Table) -> pa.Table:
    """Answers of a bucket: for each block its strings with a window that starts earlier elsewhere."""
    sizes, lo, hi, data, block = [], [], [], [], []
    for b, d in zip(table.column("block_").to_pylist(), table.column("data").to_pylist()):
        parts = unparcel(d)
        for out, x in zip((sizes, lo, hi, data), parts):
            out.append(x)
        block.append(np.full(len(parts[0]), b, np.int32))
    sizes, lo, hi, block = (np.concatenate(x) for x in (sizes, lo, hi, block))
    raw = b"".join(data)
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    strings = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw))
    words = pc.split_pattern(strings, " ")
    n_words = np.diff(words.offsets.to_numpy())
    ids = words.flatten().dictionary_encode().indices.to_numpy()
    n_windows = n_words - WINDOW + 1
    owner = np.repeat(np.arange(len(sizes)), n_windows)
    base = np.cumsum(n_windows) - n_windows
    begin = (np.cumsum(n_words) - n_words)[owner] + np.arange(len(owner)) - base[owner]
    first = first_documents(ids, begin, lo[owner])
    wanted = np.flatnonzero(np.logical_or.reduceat(first < hi[owner], base))
    wanted = wanted[np.argsort(block[wanted], kind="stable")]
    out_block, out_data = [], []
    for part in np.split(wanted, np.flatnonzero(np.diff(block[wanted])) + 1) if len(wanted) else []:
        digests = [xxhash.xxh3_128_digest(raw[offsets[k]:offsets[k + 1]]) for k in part.tolist()]
        firsts = [first[base[k]:base[k] + n_windows[k]] for k in part.tolist()]
        counts = n_windows[part].astype(np.int32)
        body = b"".join([np.int64(len(part)).tobytes(), counts.tobytes(), *digests, *(f.tobytes() for f in firsts)])
        out_block.append(int(block[part[0]]))
        out_data.append(zstandard.compress(body, 3))
    return pa.table({"block_": pa.array(out_block, pa.int32()), "data": pa.array(out_data, pa.binary())})


def read_answers(parcels: Iterator[bytes]) -> dict[bytes, np.ndarray]:
    """Digest of a string -> first documents of its windows."""
    out: dict[bytes, np.ndarray] = {}
    for data in parcels:
        raw = zstandard.decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        counts = np.frombuffer(raw, np.int32, n, 8)
        at = 8 + 4 * n
        firsts = np.split(np.frombuffer(raw, np.uint8, offset=at + 16 * n).view(np.int64), np.cumsum(counts)[:-1])
        for k, f in enumerate(firsts):
            out[raw[at + 16 * k:at + 16 * k + 16]] = f
    return out


def apply_answers(hot: np.ndarray, id_at: int, text_at: int, n_keep: int, names: list[str], rejoin: bool):
    """A block's texts without the words under repeated windows."""
    def apply(table: pa.Table, answers: pa.Table) -> pa.Table:
        known = read_answers(answers.column("data").to_pylist())
        ids = table.column(id_at).to_pylist()
        n_words = np.zeros(table.num_rows, np.int64)
        n_removed = np.zeros(table.num_rows, np.int64)
        kept: list[bytes | None] = []
        column = texts_as_bytes(table.column(text_at))
        for start, texts in grouped(column):
            usable = [t if ids[start + k] is not None else [] for k, t in enumerate(texts)]
            words, at, owner, least = minimisers(usable)
            gone = np.zeros(len(words) + 1, np.int64)
            if known and len(at):
                first, n, _ = runs(at, owner, least, hot)
                begin = at[first]
                for p, c, o in zip(begin.tolist(), n.tolist(), owner[first].tolist()):
                    firsts = known.get(xxhash.xxh3_128_digest(b" ".join(words[p:p + c + WINDOW - 1])))
                    if firsts is not None:
                        hit = p + np.flatnonzero(firsts < ids[start + o])
                        gone[hit] += 1  # a window opens here and closes WINDOW words on
                        gone[hit + WINDOW] -= 1
            removed = np.cumsum(gone)[:-1] > 0
            a = 0
            for k, t in enumerate(usable):
                flags = removed[a:a + len(t)]
                a += len(t)
                n_words[start + k] = len(texts[k])
                n_removed[start + k] = flags.sum()
                if flags.any():
                    kept.append(b" ".join([w for w, f in zip(t, flags.tolist()) if not f]))
                else:
                    kept.append(b" ".join(texts[k]) if rejoin else column[start + k])
        columns = [table.column(c).cast(table.schema.field(c).type) for c in range(n_keep)]
        return pa.table([*columns, pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())],
                        names=names)

    return apply


def remove_repeats(docs: DataFrame, keep: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text",
                   rejoin: bool = True) -> DataFrame:
    """``keep`` plus n_words, n_removed and kept (the remaining words joined by one blank).

    Without ``rejoin``, texts that lose nothing are returned as they are."""
    n = n_shuffle(docs.sparkSession)
    hot = hot_slots(docs, text, 2 * n)
    block = F.pmod(F.xxhash64(key), F.lit(2 * n)).cast("int").alias("block_")
    picked = docs.select(*keep, F.col(key).cast("long").alias("key_"), F.col(text).alias("text_"), block).repartition(n, "block_")
    id_at, text_at = len(keep), len(keep) + 1
    parcels = picked.groupBy("block_").applyInArrow(pack_block(hot, 2 * n, id_at, text_at), "bucket_ int, block_ int, data binary")
    answers = parcels.groupBy("bucket_").applyInArrow(solve_bucket, "block_ int, data binary")
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return picked.groupBy("block_").cogroup(answers.groupBy("block_")).applyInArrow(
        apply_answers(hot, id_at, text_at, len(keep), schema.names, rejoin), schema)
