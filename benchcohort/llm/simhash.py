"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits.

A fingerprint has a bit set where over half of the hashes of the text's shingles have
it. Two fingerprints are linked if at most LIMIT bits differ; components of links
are named by their smallest document.

Candidates come from pigeonring filtering. The bits are cut into LIMIT + 1 segments in
a ring. Spread over the ring, LIMIT differences leave some segment from which on every
chain of l segments differs in at most l * LIMIT / (LIMIT + 1) bits, rounded down:
none in the first, one in the first two, and so on. The first two links of the chain
are the key: a fingerprint is listed under each segment and the one after it, and
looks up the same with each zero bit of the second segment set, so a pair that begins
a chain meets under one key exactly once or as equals. The longer chains are checked
on the pair before the full Hamming distance.

Fingerprints are worked on once each, with however many documents. First, each is
compared with its ``NEIGHBOURS`` predecessors in the order of each rotation of the ring,
where those that share a chain's start stand together; this joins most of each group
of copies with at most one link a fingerprint and rotation. Then keys whose members are
all in one component need no more work, and all others are examined in full across
components: short keys by a join, long ones by blocks of their minor components against
blocks of all members. So no group is expanded into pairs, and no link between
components is missed.

Bounds: a task holds ``BLOCK`` fingerprints of a key, or a batch of texts and the
words of one; keys are shuffled as 25 bytes, about 37 a fingerprint. Fingerprints of very
many rows are looked up by a broadcast of at most 4 rows a shuffle partition.

Null and empty texts have fingerprint zero and are linked like any other. Each row is a
document: repeated rows are linked by their equal fingerprints. Null keys come last: a
component is named null only if all its keys are. An empty table gives no rows, and
no column but the key and the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut_lineage, n_shuffle, slices, texts_as_bytes
from .components import components
from .neardup import id_filter, maybe_in
from .vectors import block_join

SHINGLE = 4
SEED = 42
LIMIT = 4  # differing bits of linked fingerprints
NEIGHBOURS = 8
SHORT = 64  # members of a key that are compared by a join
BLOCK = 1024
HASHES = 1 << 16  # of a text, counted at once

RING = LIMIT + 1
#: Widths, first bits (from the top) and masks of the segments.
WIDTHS = [64 // RING + (k < 64 % RING) for k in range(RING)]
STARTS = [0, *accumulate(WIDTHS)][:-1]
MASKS = np.array([((1 << w) - 1) << (64 - s - w) for s, w in zip(STARTS, WIDTHS)], np.uint64)
BUDGETS = [(k + 1) * LIMIT // RING for k in range(RING)]


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text, lower-cased in A-Z; the whole text is the shingle if it has fewer words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = max(len(words) - shingle + 1, 1)
    cuts = map(slice, starts[:n], ends[shingle - 1:] or ends[-1:])
    set_in = np.zeros(64, np.int64)
    hashes = list(map(xxh64_intdigest, map(plain.__getitem__, cuts), repeat(seed)))
    for k in range(0, n, HASHES):
        part = np.array(hashes[k:k + HASHES], ">u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) of every row; fp holds the 64 bits as a signed number."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in texts_as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])

    return keyed.mapInArrow(work, f"key {dict(keyed.dtypes)['key']}, fp long")


def chained(differ: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the differing bits keep each chain's budget, from segment ``first`` all round the ring."""
    at, spent = np.arange(len(differ)), np.zeros(len(differ), np.int64)
    for k, budget in enumerate(BUDGETS):
        spent = spent + np.bitwise_count(differ[at] & MASKS[(first[at] + k) % RING])
        within = spent <= budget
        at, spent = at[within], spent[within]
    out = np.zeros(len(differ), bool)
    out[at] = np.bitwise_count(differ[at]) <= LIMIT
    return out


def near_in_order(fps: DataFrame) -> DataFrame:
    """Links (a, b) of each fingerprint with the nearest of its predecessors that it is linked
    with, in the order of each rotation."""
    turned = F.col("fp")
    for k, start in enumerate(STARTS[1:], 1):
        turned = F.when(F.col("first") == k, F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", 64 - start))).otherwise(turned)
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))).alias("first")).withColumn("turned", turned)
    rows = rows.repartitionByRange(n_shuffle(fps.sparkSession), "first", "turned").sortWithinPartitions("first", "turned")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            fp, first = (np.r_[x, y.to_numpy()] for x, y in zip((before, of), batch.columns))
            x, new, a, b = fp.view(np.uint64), len(before), [], []
            at = np.arange(new, len(fp))
            for back in range(1, NEIGHBOURS + 1):
                at = at[at >= back]
                ok = (first[at] == first[at - back]) & chained(x[at] ^ x[at - back], first[at])
                a.append(fp[at[ok]])
                b.append(fp[at[ok] - back])
                at = at[~ok]
            before, of = fp[-NEIGHBOURS:], first[-NEIGHBOURS:]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.select("fp", F.col("first").cast("long")).mapInArrow(link, "a long, b long")


def keyed(labelled: DataFrame) -> DataFrame:
    """(key, fp, label, own) rows: each fingerprint under the first two links of its chains (own),
    and under those with one more bit of the second."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = fp.view(np.uint64)
            for k in range(RING):
                low, start, width = (k + 1) % RING, STARTS[(k + 1) % RING], WIDTHS[(k + 1) % RING]
                second = (x & MASKS[low]) >> np.uint64(64 - start - width)
                key = np.uint64(k) << np.uint64(60) | (x & MASKS[k]) >> np.uint64(64 - STARTS[k] - WIDTHS[k]) << np.uint64(width) | second
                for bit in range(-1, width):
                    flip = np.uint64(1 << bit if bit >= 0 else 0)
                    at = np.flatnonzero((second & flip) == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key[at] | flip).view(np.int64)), pa.array(fp[at]), pa.array(label[at]), pa.array(np.full(len(at), bit < 0))],
                        names=["key", "fp", "label", "own"])

    return labelled.select("fp", "label").mapInArrow(work, "key long, fp long, label long, own boolean")


def solve_long_key(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks of a key's members; none within a component that they have joined."""
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        names, place = np.unique(np.r_[left.column("label").to_numpy(), right.column("label").to_numpy()], return_inverse=True)
        joined = np.arange(len(names))
        lx, ly = place[:left.num_rows], place[left.num_rows:]
        fx, fy = left.column("fp").to_numpy(), right.column("fp").to_numpy()
        first = int(left.column("cell")[0].as_py()) >> 60
        own_x, own_y = (t.column("own").to_numpy(zero_copy_only=False) for t in (left, right))
        for k in range(len(fx)):
            at = np.flatnonzero((joined[ly] != joined[lx[k]]) & (own_y | own_x[k]))
            at = at[chained(fy[at].view(np.uint64) ^ fx[k:k + 1].view(np.uint64), np.full(len(at), first))]
            for j in at.tolist():
                here, other = joined[lx[k]], joined[ly[j]]
                if here != other:
                    out.append((int(fx[k]), int(fy[j])))
                    joined[joined == other] = here
    a, b = zip(*out) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across_components(labelled: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of different labels: of every key whose members have several,
    each pair of labels that has a link under the key, unless the block joins them by others."""
    rows = keyed(labelled)
    mixed = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.bool_or("own").alias("found"),
                                    F.count("*").alias("n")).filter("found and least < most").select("key", "n")
    mixed = cut_lineage(mixed)
    members = cut_lineage(maybe_in(rows, id_filter(mixed.select(F.col("key").alias("id_"))), "key").join(mixed, "key"))
    side = lambda x: members.filter(F.col("n") <= SHORT).select("key", *[F.col(c).alias(c + x) for c in ("fp", "label", "own")])
    differ = F.col("fpa").bitwiseXOR(F.col("fpb"))
    spent, chain, first = F.lit(0), F.col("owna") & (~F.col("ownb") | (F.col("fpa") < F.col("fpb"))) & (F.col("labela") != F.col("labelb")), F.shiftright("key", 60)
    masks = F.array(*[F.lit(int(m.view(np.int64))) for m in MASKS])
    for k, budget in enumerate(BUDGETS):
        spent = spent + F.bit_count(differ.bitwiseAND(F.element_at(masks, (F.pmod(first + k, F.lit(RING)) + 1).cast("int"))))
        chain = chain & (spent <= budget)
    short = side("a").join(side("b"), "key").filter(chain & (F.bit_count(differ) <= LIMIT)).select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))
    long = members.filter(F.col("n") > SHORT)
    shares = long.groupBy("key", "label").agg(F.count("*").alias("m"))
    mains = shares.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    listed = lambda df: df.select(F.col("key").alias("cell"), F.concat_ws(":", "fp", "own").alias("vkey"), "fp", "label", "own")
    minor = long.join(mains, "key").filter("label <> main")
    return short.unionByName(block_join(listed(minor), listed(long), solve_long_key, "a long, b long", BLOCK, BLOCK, few_cells=False))


def looked_up(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``found``, which has each of their keys once.

    A key of more than a 4 * partitions-th of the rows is looked up by broadcast: there are
    fewer than that many. All others are joined by shuffle, of which none can fill a task."""
    most = rows.count() // (4 * n_shuffle(rows.sparkSession))
    hot = cut_lineage(rows.groupBy(key).count().filter(F.col("count") > most).select(key).join(found, key))
    named = hot.select(F.col(key).alias("hot_"), *[c for c in hot.columns if c != key])
    held = rows.join(F.broadcast(named), F.col(key) == F.col("hot_")).drop("hot_")
    rest = rows.join(F.broadcast(named.select("hot_")), F.col(key) == F.col("hot_"), "left_anti").join(found, key)
    return held.unionByName(rest.select(*held.columns))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key reachable by links."""
    rows = cut_lineage(fingerprints(docs, key, text))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("key").alias("least")))
    links = cut_lineage(near_in_order(fps))
    label = lambda links: fps.join(components(links), F.col("fp") == F.col("node"), "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("label"))
    more = cut_lineage(across_components(cut_lineage(label(links))))
    labelled = cut_lineage(label(links.unionByName(more)))
    named = cut_lineage(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    named = cut_lineage(looked_up(labelled.select("fp", "label"), named, "label").select("fp", "component_id"))
    return looked_up(rows, named, "fp").select(F.col("key").alias(key), "fp", "component_id")
