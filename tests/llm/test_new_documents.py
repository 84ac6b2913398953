"""SimHash, importance resampling and periodic runs against brute force."""

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
import xxhash

from benchcohort.llm import importance, periodic, queries, simhash

from .data import SCHEMA, documents, sentence

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    """The awkward documents as tables of a scale-factor folder."""
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("tables")
    more = [(k, " ".join(rng.choice("abcde") for _ in range(300)), "en", "s1", 0, 0.0, True) for k in range(1000, 1080)]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(str(path / "documents.parquet"))
    target = [(1, rows[0][1]), (2, sentence(rng, 50)), (3, None), (4, "")]
    spark.createDataFrame(target, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), [(r[0], r[1]) for r in rows + more], [t for _, t in target]


# ------------------------------------------------------------------- SimHash
def plain_fingerprint(text):
    words = [w.lower() for w in WORD.findall((text or "").encode())]
    parts = [b" ".join(words[k:k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(p, 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit=4):
    """Smallest key reachable, by all pairs of (key, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= limit:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_query_equals_brute_force(spark, sf_dir):
    path, docs, _ = sf_dir
    prints = [(k, plain_fingerprint(t)) for k, t in docs]
    want = sorted([(str(k), f"{x:016x}", c) for (k, x), c in zip(prints, plain_components(prints))], key=str)
    got = queries.QUERIES["op11_simhash_duplicates"](spark, path).collect()
    assert sorted([(str(r.doc_id), r.fingerprint, r.component_id) for r in got], key=str) == want
    assert len({c for *_, c in want}) < len(want) - 50


def prints_of(rng, n):
    """Random fingerprints, chains of close ones and a dense ball."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n // 8):
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 9)):
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << bit
            out.append(x)
    centre = rng.getrandbits(64)
    for _ in range(n):
        x = centre
        for bit in rng.sample(range(64), rng.randrange(0, 7)):
            x ^= 1 << bit
        out.append(x)
    # few bits only, so that many share keys without being linked
    out += [rng.getrandbits(24) for _ in range(n)]
    return out


@pytest.mark.parametrize("neighbours,short,block", [(simhash.NEIGHBOURS, simhash.SHORT, simhash.BLOCK), (0, 3, 16), (1, 8, 64), (0, 10**6, 16)])
def test_pigeonring_links_equal_all_pairs(spark, monkeypatch, neighbours, short, block):
    for name, value in (("NEIGHBOURS", neighbours), ("SHORT", short), ("BLOCK", block)):
        if name != "NEIGHBOURS" or value:
            monkeypatch.setattr(simhash, name, value)
    if not neighbours:  # all links by the second pass
        monkeypatch.setattr(simhash, "near_in_order", lambda fps: fps.sparkSession.createDataFrame([], "a long, b long"))
    rng = random.Random(neighbours + short)
    prints = list(enumerate(prints_of(rng, 150)))
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in prints]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    got = simhash.near_duplicates(spark.createDataFrame(signed, "key long, fp long")).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == plain_components(prints)


def test_every_near_pair_begins_a_chain():
    rng = random.Random(1)
    differ = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 8))) for _ in range(3000)], np.uint64)
    any_start = np.any([simhash.chained(differ, np.full(len(differ), k)) for k in range(simhash.RING)], axis=0)
    assert np.array_equal(any_start, np.bitwise_count(differ) <= simhash.LIMIT)


def test_simhash_of_nothing_and_of_other_names(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", 5, 6, "x"), (2, "A b  C", 7, 8, "y"), (3, None, 1, 1, "z"), (4, "", 1, 1, "z")],
                                 "fp long, label string, key long, component_id long, first string")
    got = simhash.near_duplicates(docs, key="fp", text="label").toDF("k", "print", "component").collect()
    assert sorted((r.k, r.component) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 3)]


# -------------------------------------------------------- importance resampling
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = FEATURE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k:k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets=10_000):
    count = lambda texts: np.bincount([crc32(f.encode()) % buckets for t in texts for f in plain_features(t)[1]], minlength=buckets)
    s, t = count([x for _, x in docs]).tolist(), count(target).tolist()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for k, text in docs:
        n, found = plain_features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    open_to = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0], r[3], r[2]))
    for place, r in enumerate(open_to[:5 * len(open_to) // 100], 1):
        r[5] = place
    return sorted([(r[0], *r[2:]) for r in out], key=str)


@pytest.mark.parametrize("piece", [importance.PIECE, 1000, 7])
def test_resampling_query_equals_brute_force(spark, sf_dir, monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)  # texts longer than a piece are cut
    path, docs, target = sf_dir
    got = queries.QUERIES["op12_importance_resampling"](spark, path).collect()
    want = plain_resample(docs, target)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got], key=str) == want
    assert sum(r[-1] is not None for r in want) >= 5


def test_drawn_documents_keep_their_columns(spark, sf_dir):
    path, docs, _ = sf_dir
    table = spark.read.parquet(path + "/documents.parquet").withColumnsRenamed({"score": "rank", "kept": "key_"})
    got = importance.drawn(table, spark.read.parquet(path + "/benchmark.parquet"))
    assert got.columns == table.columns
    assert got.count() == sum(r[-1] is not None for r in plain_resample(docs, sf_dir[2]))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a " * 30), (1, "a " * 30), (None, "b " * 30), (2, None)], "doc_id long, text string")
    got = importance.resample(one, none, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert [r["rank"] for r in got if r.doc_id == 2] == [None]


# --------------------------------------------------------------- periodic runs
def plain_runs(ids, least=12):
    n, out = len(ids), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ids[j] == ids[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and j > i:
                w = ids[i:j + p]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_words(rng, kind):
    pick = lambda k, n: [rng.randrange(k) for _ in range(n)]
    if kind == 0:
        return pick(2, rng.randrange(150))
    if kind == 1:  # one long run with a few breaks
        x = (pick(3, rng.randrange(1, 40)) * 8)[:rng.randrange(1, 220)]
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = 7
        return x
    if kind == 2:  # two touching runs of one period
        u = pick(2, rng.randrange(1, 5))
        k = rng.randrange(len(u))
        return u * rng.randrange(1, 30) + (u[k:] + u[:k]) * rng.randrange(1, 30) + u * 5
    if kind == 3:  # runs within a run
        x = []
        while len(x) < rng.randrange(1, 140):
            x += pick(3, rng.randrange(1, 6)) * rng.randrange(1, 12)
        return x * 3
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    k = rng.randrange(len(b))
    return b[k:] + b[:k]


@pytest.mark.parametrize("direct", [4, 8, 32])
def test_runs_equal_brute_force(monkeypatch, direct):
    monkeypatch.setattr(periodic, "DIRECT", direct)  # the smaller, the more scales of minimizers
    rng, total = random.Random(direct), 0
    for k in range(120):
        x, least = repeated_words(rng, k % 5), rng.choice([1, 4, 12])
        got = [(a, b - a, p) for a, b, p in periodic.find_runs(np.array(x, np.int32), least).tolist()]
        assert got == plain_runs(x, least), x
        total += len(got)
    assert total > 1000


def test_long_repetitive_texts_stay_cheap():
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int32)).tolist() == [[0, n, 1]]
    rng = random.Random(2)
    block = [rng.randrange(50) for _ in range(n // 4)]
    runs = periodic.find_runs(np.array(block * 4, np.int32))
    assert runs[np.argmax(runs[:, 1] - runs[:, 0])].tolist() == [0, n, n // 4]


def plain_periodic(k, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = crc32(str(k).encode()) if k is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (str(k), len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha(b"".join(b"%d,%d,%d\n" % r for r in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("batch", [periodic.BATCH, 40])
def test_periodic_query_equals_brute_force(spark, sf_dir, monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH", batch)
    path, docs, _ = sf_dir
    short = [(k, t) for k, t in docs if len(t or "") < 20_000]  # brute force is quadratic
    got = [(str(r[0]), *r[1:]) for r in queries.QUERIES["op13_periodic_runs"](spark, path).collect()]
    assert len(got) == len(docs)
    want = sorted((plain_periodic(k, t) for k, t in short), key=str)
    long = {str(k) for k, t in docs if len(t or "") >= 20_000}
    assert sorted((r for r in got if r[0] not in long), key=str) == want
    assert sum(r[1] > 0 for r in want) > 10


def test_collapse_of_nothing_and_of_other_names(spark):
    assert periodic.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([("k", "x y " * 8 + "z", 1)], "collapsed string, runs string, n_words int")
    row = periodic.collapse(docs, key="collapsed", text="runs").toDF("k", "n", "r", "c").first()
    assert (row.k, row.n, [tuple(r) for r in row.r], row.c) == ("k", 17, [(0, 16, 2)], "x y z")
