"""Periodic run detection: every maximal run of words that repeats with a period.

A run is a stretch of consecutive words with smallest period q, at least 2 q words
long, that no neighbouring word extends. Runs of all periods are found exactly:

* Periods under ``DIRECT`` by lag scans: words are compared with those p further on.
* Longer ones by multi-scale minimizers. Scale P looks for periods of P to 2 P - 1.
  Its items are stretches of P / 4 words, named exactly by doubling; a window of
  P / 2 items has a least one (by a scrambled name, leftmost among equals). Windows
  one period apart hold the same items, so within a run their minima lie one period
  apart: pairs of equal minima at such a distance are the seeds, and a seed that
  extends to twice its distance is a run.
* Where items are periodic themselves, minima repeat at every step of the small
  period, and pairing them all would be quadratic. Such items lie in runs that a
  smaller scale has found. A longer run over two of those has, by the periodicity
  lemma, the distance of their starts or of their ends as its period, unless the two
  touch; touching ones give one run for each distance that keeps them in phase, with
  both ends known. So these seeds come from the runs, and pairs of minima within runs
  of small periods are left out.

Items that occur once within reach are dropped at each scale, and only what is left is
named at the next one, so ordinary text costs little beyond the lag scans.

A text is worked on as a whole, in arrays of its words' numbers: about 100 bytes a word
of the longest text, beside ``BATCH`` words of shorter ones. One pass, no shuffle.

Null and empty texts have no runs and an empty collapsed text. Rows are independent of
each other: repeated rows and null keys are returned as they come, and no column but
the key and the text is looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_as_bytes

DIRECT = 32  # periods under this are scanned for lag by lag; a power of two
LEAST = 12  # words of the shortest run reported
BATCH = 1 << 16  # words of short texts worked on together
STEP = 64  # words compared at once when a seed is extended
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the stretches of true values."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    breaks = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]] + 1


def smallest_period(ids: np.ndarray, start: int, end: int, p: int) -> bool:
    """Whether no part of p is a period of the stretch, which has period p at least twice."""
    rest, factor = p, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            q = p // factor
            # one period tells: a stretch of period p whose first p + q words have period q has it throughout
            if np.array_equal(ids[start:start + p], ids[start + q:start + q + p]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def lag_scan(ids: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end, period) of the periods under DIRECT, from ``least`` or DIRECT / 4 words on."""
    found = []
    for p in range(1, min(DIRECT, len(ids) // 2 + 1)):
        a, b = stretches(ids[:-p] == ids[p:])
        long = b - a >= max(p, min(least, DIRECT // 4) - p)
        for start, end in zip(a[long].tolist(), (b[long] + p).tolist()):
            if smallest_period(ids, start, end, p):
                found.append((start, end, p))
    return np.array(found, np.int64).reshape(-1, 3)


def named(pairs_high: np.ndarray, pairs_low: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(pairs_high * (int(pairs_low.max(initial=0)) + 1) + pairs_low, return_inverse=True)[1].astype(np.int64)


def repeated(at: np.ndarray, names: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one, and which have one within ``reach`` words; items come in order of place."""
    order = np.argsort(names, kind="stable")
    equal = np.diff(names[order]) == 0
    near = equal & (np.diff(at[order]) < reach)
    out = []
    for pairs in (equal, near):
        keep = np.zeros(len(at), bool)
        keep[order[1:][pairs]] = keep[order[:-1][pairs]] = True
        out.append(keep)
    return tuple(out)


def doubled(at: np.ndarray, names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of 2 * size words from those of ``size`` words."""
    where = np.minimum(np.searchsorted(at, at + size), max(len(at) - 1, 0))
    both = at[where] == at + size
    return at[both], named(names[both], names[where[both]])


def minimizers(at: np.ndarray, names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the least items of all windows of ``width`` consecutive items."""
    if len(at) < width:
        return at[:0], names[:0]
    rank = ((names.astype(np.uint64) + np.uint64(1)) * GOLDEN) >> np.uint64(32)
    rank = (rank << np.uint64(32)) | np.arange(len(at), dtype=np.uint64)  # leftmost among equals
    size = 1
    while size < width:
        rank = np.minimum(rank[:-size], rank[size:])
        size *= 2
    whole = at[width - 1:] - at[:len(at) - width + 1] == width - 1  # no dropped item inside
    least = np.unique((rank[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at[least], names[least]


def pairs_within(at: np.ndarray, group: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of one group, ``low`` to ``high - 1`` words apart, step by step of the order within the group."""
    order = np.lexsort((at, group))
    at, group = at[order], group[order]
    first, step = np.arange(len(at)), 0
    while len(first):
        step += 1
        first = first[first + step < len(at)]
        near = (group[first] == group[first + step]) & (at[first + step] - at[first] < high)
        first = first[near]
        far = at[first + step] - at[first] >= low
        yield at[first[far]], at[first[far] + step]


def extended(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The stretch with period p around the words at ``at`` and p further on."""
    start, end, size, n = at, at, STEP, len(ids)
    while end + p < n:
        stop = min(end + size, n - p)
        differ = np.flatnonzero(ids[end:stop] != ids[end + p:stop + p])
        if len(differ):
            end += int(differ[0])
            break
        end, size = stop, 2 * size
    size = STEP
    while start > 0:
        stop = max(start - size, 0)
        differ = np.flatnonzero(ids[stop:start] != ids[stop + p:start + p])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, size = stop, 2 * size
    return start, end + p


def small_runs(runs: np.ndarray, item: int) -> np.ndarray:
    """Runs that hold items periodic themselves: period up to half an item, by start."""
    runs = runs[(runs[:, 2] <= item // 2) & (runs[:, 1] - runs[:, 0] >= item)]
    return runs[np.argsort(runs[:, 0], kind="stable")]


def touching(ids: np.ndarray, small: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Runs of ``low`` to ``high - 1`` words' period over two touching runs of one small period.

    The second begins at a word of the first or at the next one; a distance that keeps
    them in phase gives a run from one's start or a distance before the other's, to one's
    end or a distance after the other's."""
    found = []
    for q in np.unique(small[:, 2]).tolist():
        same = small[small[:, 2] == q]
        for k in np.flatnonzero(same[:-1, 1] >= same[1:, 0]).tolist():
            (a, b, _), (c, d, _) = same[k].tolist(), same[k + 1].tolist()
            head = ids[c:c + q]
            shift = next((s for s in range(q) if np.array_equal(ids[a + s:a + s + q], head)), None)
            if shift is None or a + shift + q > b:
                continue
            phase = (c - a - shift) % q  # distances that map the first run onto the second
            for p in range(low + (phase - low) % q, min(high, (d - a) // 2 + 1), q):
                start, end = max(a, c - p), min(d, b + p)
                # equal starts or ends, a period apart, may go on beyond both: those are seeds of their own
                if end - start >= 2 * p and c - p != a and d - p != b:
                    found.append((start, end, p))
    return found


def alive(ids: np.ndarray, first: np.ndarray, second: np.ndarray, steps: int) -> np.ndarray:
    """Seeds whose words agree for some steps to the right or to the left, looked at all together.

    A run holds a whole period beside its seed, so half of one at least on some side."""
    at = np.arange(len(first))
    right = left = np.ones(len(first), bool)
    top = len(ids) - 1
    for step in range(steps):
        x, y = first[at], second[at]
        right = right & (ids[np.minimum(x + step, top)] == ids[np.minimum(y + step, top)])
        left = left & (x >= step) & (ids[np.maximum(x - step, 0)] == ids[np.maximum(y - step, 0)])
        both = right | left
        at, right, left = at[both], right[both], left[both]
        if not len(at):
            break
    return at


def long_runs(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """``runs``, which are those of periods under DIRECT, and those of all longer periods."""
    at, names, size = np.arange(len(ids)), ids.astype(np.int64) - ids.min(initial=0), 1
    while size < DIRECT // 4:
        keep = repeated(at, names, 0)[0]
        at, names = doubled(at[keep], names[keep], size)
        size *= 2
    low = DIRECT
    while low <= len(ids) // 2 and len(at):
        high, item = 2 * low, low // 4
        again, near = repeated(at, names, high)
        small = small_runs(runs, item)
        places, group = minimizers(at[near], names[near], low // 2)
        # minima whose item lies in a run of a small period are paired through the runs
        depth = np.zeros(len(places) + 1, np.int64)
        np.add.at(depth, np.searchsorted(places, small[:, 0]), 1)
        np.subtract.at(depth, np.searchsorted(places, small[:, 1] - item, side="right"), 1)
        free = np.cumsum(depth[:-1]) == 0
        kind = small[:, 2]
        seeds = [pair for places_, group_ in ((places[free], group[free]), (small[:, 0], kind), (small[:, 1] - 1, kind))
                 for pair in pairs_within(places_, group_, low, high)]
        found = set(touching(ids, small, low, high))
        if seeds:
            first, second = (np.concatenate([s[k] for s in seeds]) for k in (0, 1))
            on = alive(ids, first, second, min(STEP, low // 2))
            first, period = first[on], (second - first)[on]
            last = (-1, -1, 0)
            for k in np.lexsort((first, period)).tolist():
                p, m = int(period[k]), int(first[k])
                if last[2] == p and last[0] <= m and m + p < last[1]:
                    continue  # within the stretch extended last
                last = (*extended(ids, m, p), p)
                if last[1] - last[0] >= 2 * p:
                    found.add(last)
        fresh = sorted(r for r in found if smallest_period(ids, *r))
        runs = np.r_[runs, np.array(fresh, np.int64).reshape(-1, 3)]
        at, names = doubled(at[again], names[again], item)
        low = high
    return runs


def find_runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs (start, end, period) of at least ``least`` words, by start, then period."""
    runs = long_runs(ids, lag_scan(ids, least))
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run beyond its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:n]) > 0


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, and the texts' offsets. No two texts share a number,
    and one that occurs once stands after each text, so nothing repeats across texts."""
    ids, offsets, fresh = [], [0], count()
    for words in texts:
        ids += map(defaultdict(fresh.__next__).__getitem__, words)
        ids.append(next(fresh))
        offsets.append(len(ids))
    return np.array(ids, np.int32), np.array(offsets)


def groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, some BATCH of them at a time."""
    held, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > BATCH:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed): each text's runs of at least ``least`` words, by start,
    then period, and its words without those that lie in a run beyond the run's first period."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            done = 0
            for texts in groups(texts_as_bytes(batch.column(1))):
                ids, offsets = numbered(texts)
                runs = find_runs(ids, least)
                gone = repeats(len(ids), runs)
                owner = np.searchsorted(offsets, runs[:, 0], side="right") - 1
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                starts = runs[:, 0] - offsets[owner]
                kept = [b" ".join([w for w, g in zip(words, gone[offsets[k]:].tolist()) if not g]) if ends[k] < ends[k + 1]
                        else b" ".join(words) for k, words in enumerate(texts)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(starts), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(RUNS.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), pa.array([len(w) for w in texts], pa.int64()), listed,
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])
                done += len(texts)

    schema = f"key {dict(keyed.dtypes)['key']}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return keyed.mapInArrow(work, schema).toDF(key, "n_words", "runs", "collapsed")
