"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct shingles of ``SHINGLE``
words; its sketch is the ``K`` smallest of them, or the whole set up to ``WHOLE``.
Documents with equal sets are collapsed first. The others meet in inverted lists of
retained values, taken in one global order, rarest first (counted by slot over all
sketches). Two whole sets of the wanted similarity share all but a few of either's
values, so they share one of each's few rarest and one more; these are indexed, without
any loss. A set that may have a partner beyond WHOLE is indexed by its ``INDEXED``
smallest values: if two share at least ``SHARED`` of these they share one among the first
INDEXED - SHARED + 1; two documents with similarity 0.85 share fewer with a probability
below 1e-7. The two indexes have lists of their own. As many values of a short text are
looked at, what it shares with very many others is indexed only where it is nearly all of it.

Lists are not expanded into pairs. Each names ``HUBS`` members with the commonest
values, the likely originals, and every member is paired with these only. Pairs
pass if sizes allow the similarity and the similarity of the union sketch comes
near it, within five standard deviations of a sample of that size. Where both
sketches hold the whole sets, that similarity is exact; other pairs are verified
on full sets. Components of the links follow. What could be lost are links
between members of one list that fell into different components: in those lists,
every member outside the list's largest component is compared with all members of
other components (inside the tasks, which pass on only pairs that could join two
components), verified, and the components are taken again. So copies in thousands
cost a few pairs each, and no link between components is dropped.

Sketches and texts are joined to pairs after a filter by a bitmap of the ids in
pairs; it has ``BITS`` bits at every size and lets some others through, which
the join removes.

Defined results: null and empty texts have empty sets and are linked with
nothing; texts with fewer words than a shingle have one shingle; rows that
share a doc_id are one document; rows with a null doc_id are linked with nothing
(component null, kept true); an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_few, cut_lineage, give_back, slices, texts_as_bytes
from .components import components
from .substring import _HASHES, _MIX1, _MIX3, grouped, scrambled
from .vectors import block_join

SHINGLE = 5
#: Similarity asked for, in hundredths.
PERCENT = 85
#: Values of a sketch; how many of its smallest are indexed from, and how many of
#: those similar sketches share at least.
K, INDEXED, SHARED = 128, 64, 38
#: Values up to which a sketch is the whole set.
WHOLE = 256
#: Slots in which values are counted, and hubs of a list.
SLOTS, HUBS = 1 << 20, 3
#: Standard deviations by which an estimate may fall short of the similarity.
DEVIATIONS = 5.0
#: Bits of the filter of ids in pairs, and of one row of it (a fixed value of Spark's bitmaps).
BITS, BITMAP_ROW = 1 << 26, 32768
#: Lists above this length are compared block by block, shorter ones by a join.
LONG_LIST, BLOCK = 256, 4096

NO_VALUE = np.uint64(2**64 - 1)


def shingle_sets(texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    lowered = [t.lower() if t else t for t in texts]
    for _, group in grouped(lowered):
        words = [w for t in group for w in t]
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        run = h
        for k in range(1, SHINGLE):
            run = scrambled((run[:-1] * _MIX1) ^ (h[k:] * _MIX3)) if len(h) >= SHINGLE else run
        a = 0
        for t in group:
            if len(t) >= SHINGLE:
                yield np.unique(run[a:a + len(t) - SHINGLE + 1])
            elif t:
                yield np.array([xxhash.xxh3_64_intdigest(b" ".join(t), seed=len(t))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            a += len(t)


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, setkey (digest of the set) and sketch for every row."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, keys, sketches = [], [], []
            for s in shingle_sets(texts_as_bytes(batch.column(1))):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append((s if len(s) <= WHOLE else s[:K]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "setkey", "sketch"])

    picked = docs.select(F.col(key).cast("long").alias("doc_id"), text)
    return picked.mapInArrow(sketch, "doc_id long, n_shingles long, setkey binary, sketch binary")


def sketch_rows(column: pa.Array) -> np.ndarray:
    """Sketches as rows of as many values as the longest has, short ones filled up."""
    parts = column.to_pylist()
    sizes = np.array([len(p) // 8 for p in parts], np.int64)
    width = max(int(sizes.max(initial=0)), 1)
    out = np.full((len(parts), width), NO_VALUE, np.uint64)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(parts), np.uint64)
    return out


def slots_of(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(7)).astype(np.int64) % SLOTS


def value_counts(reps: DataFrame) -> np.ndarray:
    """How many sketches hold a value of each slot."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            rows = sketch_rows(batch.column(0))
            n += np.bincount(slots_of(rows[rows != NO_VALUE]), minlength=SLOTS)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n[slot])], names=["slot", "n"])

    got = reps.select("sketch").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.float32)  # SLOTS rows at most
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def indexes_of(rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]]:
    """(place of the sketches, their values, how many of them are indexed, mark of the lists) of each index."""
    whole = np.flatnonzero(n <= WHOLE)
    yield whole, rows[whole], n[whole] - -(-PERCENT * n[whole] // 100) + 1, np.uint64(0)
    # a partner has n / 0.85 values at most
    cut = np.flatnonzero(100 * n > PERCENT * WHOLE)
    yield cut, rows[cut, :INDEXED], np.full(len(cut), INDEXED - SHARED + 1), np.uint64(1 << 63)


def postings(reps: DataFrame, counts: np.ndarray) -> DataFrame:
    """value, rep, n, weight (how common the sketch's values are) for the indexed values."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.column(1).to_numpy()
            all_rows = sketch_rows(batch.column(2))
            for at, rows, indexed, mark in indexes_of(all_rows, n):
                there = rows != NO_VALUE
                common = np.where(there, counts[slots_of(rows)], np.inf)
                weight = np.where(there, common, 0).sum(1) / np.maximum(there.sum(1), 1)
                order = np.lexsort((rows, common), axis=1)[:, :int(indexed.max(initial=0))]
                rows = np.take_along_axis(rows, order, axis=1)
                used = np.arange(rows.shape[1]) < indexed[:, None]
                owner = np.nonzero(used)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((rows[used] >> np.uint64(1) | mark).view(np.int64)), batch.column(0).take(pa.array(at[owner])),
                     pa.array(n[at[owner]]), pa.array(weight[owner])], names=["value", "rep", "n", "weight"])

    return reps.select("rep", "n", "sketch").mapInArrow(post, "value long, rep long, n long, weight double")


def estimates(a: np.ndarray, b: np.ndarray, truncated: np.ndarray) -> np.ndarray:
    """Similarity by union sketches; exact where neither side is truncated."""
    out = np.zeros(len(a))
    for rows, limit in ((np.flatnonzero(truncated), K), (np.flatnonzero(~truncated), 2 * WHOLE)):
        if not len(rows):
            continue
        both = np.sort(np.concatenate([a[rows, :limit], b[rows, :limit]], axis=1), axis=1)
        real = both != NO_VALUE
        twin = np.zeros(both.shape, bool)
        twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        place = np.cumsum(real & ~twin, axis=1)  # of each value in the union, counted from 1
        size = np.minimum(place[:, -1], limit)
        out[rows] = (twin & (place <= limit)).sum(1) / np.maximum(size, 1)
    return out


def passing(estimate: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimates that a pair of similar sets may have; exact where both sketches are whole."""
    goal = PERCENT / 100
    union = np.maximum((na + nb) / (1 + goal), K)
    margin = DEVIATIONS * np.sqrt(goal * (1 - goal) / K * (1 - K / union)) + 1 / K
    return estimate >= goal - np.where((na > WHOLE) | (nb > WHOLE), margin, 1e-9)


def sizes_allow(a: str, b: str):
    return PERCENT * F.greatest(a, b) <= 100 * F.least(a, b)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids (``id_``): BITS / BITMAP_ROW rows at most, whatever the ids."""
    slot = slot_of("id_") + 1
    rows = ids.groupBy(F.bitmap_bucket_number(slot).alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        at = (r.row - 1) * BITMAP_ROW // 8
        out[at:at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def slot_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def maybe_in(rows: DataFrame, bitmap: np.ndarray, key: str) -> DataFrame:
    """``rows`` whose key may be among the ids of the bitmap."""
    names = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            hit = bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
            part = batch.filter(pa.array(hit.astype(bool)))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names)

    return rows.withColumn("slot_", slot_of(key)).mapInArrow(keep, rows.schema)


def ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id_"))


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b, exact) whose union sketch comes near enough; exact: they are links."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            truncated = (na > WHOLE) | (nb > WHOLE)
            for k in range(0, len(na), BLOCK):
                part = slice(k, k + BLOCK)
                ok = passing(estimates(sketch_rows(batch.column(4)[part]), sketch_rows(batch.column(5)[part]), truncated[part]),
                             na[part], nb[part])
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(~truncated[part])],
                                                 names=["a", "b", "exact"]).filter(pa.array(ok))
        give_back()

    near = maybe_in(reps.select("rep", "n", "sketch"), id_filter(ids_of(pairs)), "rep")
    side = lambda x: near.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    rows = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(check, "a long, b long, exact boolean")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b): exact pairs, and others whose full sets are similar enough. Only texts in pairs move."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_text, held = None, None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            text_a, text_b = batch.column(2), texts_as_bytes(batch.column(3))
            ok = []
            for k, s in enumerate(shingle_sets(text_b)):
                if a[k] != last or not text_a[k].equals(last_text):  # rows come sorted by a, which may have several texts
                    last, last_text, held = a[k], text_a[k], next(iter(shingle_sets(texts_as_bytes(text_a.slice(k, 1)))))
                common = len(np.intersect1d(held, s, assume_unique=True))
                ok.append(common > 0 and 100 * common >= PERCENT * (len(held) + len(s) - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) \
                .filter(pa.array(ok, pa.bool_()))

    open_pairs = pairs.filter("not exact").select("a", "b")
    wanted = ids_of(open_pairs).distinct()
    rows = docs.select(F.col(key).cast("long").alias("id_"), F.col(text).alias("text_")).filter(F.col("id_").isNotNull())
    # an id may have several texts, and a pair is a link if any two of them are
    texts = maybe_in(rows, id_filter(wanted), "id_").dropDuplicates(["id_", "text_"])
    side = lambda x: texts.select(F.col("id_").alias(x), F.col("text_").alias(f"t{x}"))
    both = open_pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a").select("a", "b", "ta", "tb")
    return pairs.filter("exact").select("a", "b").unionByName(both.mapInArrow(verify, "a long, b long"))


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def solve_long_list(left: pa.Table, right: pa.Table) -> pa.Table:
    """Passing pairs between the outsiders and the members of a block of a long list.

    Exact pairs join components at once, and no pair within a joined one is passed on."""
    out: list[tuple[int, int, bool]] = []
    if left.num_rows and right.num_rows:
        x, y = sketch_rows(left.column("sketch").combine_chunks()), sketch_rows(right.column("sketch").combine_chunks())
        nx, ny = left.column("n").to_numpy(), right.column("n").to_numpy()
        names, place = np.unique(np.r_[left.column("component").to_numpy(), right.column("component").to_numpy()],
                                 return_inverse=True)
        joined = np.arange(len(names))  # which component each has become part of, here
        cx, cy = place[:len(x)], place[len(x):]
        ids, others = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        # values of the members in order, to count the values that each shares with an outsider
        there = y != NO_VALUE
        order = np.argsort(y[there], kind="stable")
        values, owners = y[there][order], np.nonzero(there)[0][order]
        for k in range(len(x)):
            mine = x[k][x[k] != NO_VALUE]
            begin, end = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            shared = np.bincount(np.concatenate([owners[i:j] for i, j in zip(begin.tolist(), end.tolist())]), minlength=len(y))
            truncated = (ny > WHOLE) | (nx[k] > WHOLE)
            # sharing bounds the similarity of truncated sketches from above, and is exact for whole ones
            most = np.where(truncated, shared / K, shared / np.maximum(nx[k] + ny - shared, 1))
            at = np.flatnonzero((joined[cy] != joined[cx[k]]) & passing(most, np.full(len(y), nx[k]), ny)
                                & (PERCENT * np.maximum(ny, nx[k]) <= 100 * np.minimum(ny, nx[k])))
            unsure = at[truncated[at]]
            for part in np.array_split(unsure, max(1, len(unsure) // BLOCK)):
                most[part] = estimates(np.repeat(x[k:k + 1], len(part), axis=0), y[part], truncated[part])
            at = at[passing(most[at], np.full(len(at), nx[k]), ny[at])]
            for j, exact in zip(at.tolist(), (~truncated[at]).tolist()):
                here, other = joined[cx[k]], joined[cy[j]]
                if here != other:
                    out.append((int(ids[k]), int(others[j]), exact))
                    if exact:
                        joined[joined == other] = here
    a, b, exact = zip(*out) if out else ((), (), ())
    return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64()), "exact": pa.array(exact, pa.bool_())})


def across_components(lists: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """Passing pairs between members of one list that are in different components.

    A list has a largest component; a pair across components has a member
    outside of it. Lists of HUBS + 1 members or fewer have been compared in full."""
    labelled = lists.filter(F.col("c") > HUBS + 1).join(found, F.col("rep") == F.col("node"), "left") \
        .select("value", "c", "rep", "n", F.coalesce("component", "rep").alias("component"))
    shares = labelled.groupBy("value", "component").agg(F.count("*").alias("m"))
    mains = shares.groupBy("value").agg(F.max_by("component", F.struct("m", "component")).alias("main"),
                                        F.count("*").alias("parts")).filter("parts > 1")
    mixed = cut_few(labelled.join(mains, "value"))
    outside = mixed.filter("component <> main")
    short = outside.filter(F.col("c") <= LONG_LIST).select("value", "rep", "n", "component")
    members = mixed.filter(F.col("c") <= LONG_LIST).select("value", F.col("rep").alias("rep2"), F.col("n").alias("n2"),
                                                           F.col("component").alias("component2"))
    pairs = short.join(members, "value").filter((F.col("component") != F.col("component2")) & sizes_allow("n", "n2")) \
        .select(*ordered("rep", "rep2")).distinct()
    sketches = reps.select("rep", "sketch")
    full = lambda side: side.filter(F.col("c") > LONG_LIST).join(sketches, "rep").select(
        F.col("value").alias("cell"), F.col("rep").cast("string").alias("vkey"), "rep", "n", "component", "sketch")
    long_pairs = block_join(full(outside), full(mixed), solve_long_list, "x long, y long, exact boolean", BLOCK, BLOCK,
                            few_cells=False)
    return estimated(cut_few(pairs), reps).unionByName(long_pairs.select(*ordered("x", "y"), "exact")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row."""
    rows = cut_lineage(sketched(docs, key, text))
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = cut_lineage(known.groupBy("setkey").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                                    F.first("sketch").alias("sketch")))
    posted = postings(reps, value_counts(reps))
    sizes = posted.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    lists = cut_lineage(posted.join(sizes, "value"))
    first = W.partitionBy("value").orderBy(F.desc("weight"), "rep")
    hubs = lists.withColumn("rn_", F.row_number().over(first)).filter(F.col("rn_") <= HUBS) \
        .select("value", F.col("rep").alias("hub"), F.col("n").alias("hub_n"))
    pairs = lists.join(hubs, "value").filter((F.col("rep") != F.col("hub")) & sizes_allow("n", "hub_n")) \
        .select(*ordered("rep", "hub")).distinct()
    pairs = cut_few(pairs)
    links = cut_few(verified(cut_few(estimated(pairs, reps)), docs, key, text))
    # sets that one doc_id has hang together
    same = known.join(reps.select("setkey", "rep"), "setkey").groupBy("doc_id").agg(F.collect_set("rep").alias("r")) \
        .filter(F.size("r") > 1).select(F.array_min("r").alias("a"), F.explode("r").alias("b")).filter("a <> b")
    found = components(links.unionByName(same))
    more = cut_few(verified(cut_few(across_components(lists, found, reps)), docs, key, text))
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    labels = reps.join(found, F.col("rep") == F.col("node"), "left") \
        .select(F.col("setkey").alias("setkey_"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.select("doc_id", "n_shingles", "setkey").join(
        labels, (F.col("setkey") == F.col("setkey_")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return linked.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
