"""Substring and near-duplicate operators against brute force."""

import random

import numpy as np
import pytest

from benchcohort.llm import neardup, substring
from benchcohort.llm.components import components

from .data import SCHEMA, documents, near_components, shingles, substring_kept, words


@pytest.fixture(scope="module")
def rows():
    return documents()


def kept_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in df.collect())


@pytest.mark.parametrize("hot", [substring.HOT_SHARE, 0.0])
def test_substring_equals_brute_force(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SHARE", hot)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted((k is None, k or 0, n, g, t) for k, n, g, t in substring_kept([r[:2] for r in rows]))
    assert kept_rows(substring.remove_repeats(docs)) == want
    assert sum(w[3] for w in want) > 500


def test_substring_without_rejoining_keeps_untouched_texts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {r[0]: r[1] for r in rows}
    for r in substring.remove_repeats(docs, rejoin=False).collect():
        if r.n_removed == 0 and r.doc_id is not None:
            assert r.kept == texts[r.doc_id]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring, "scrambled", lambda x: x * np.uint64(0))
    ids = np.array([*range(13), *range(5, 18), *range(13)], np.int64)
    first = substring.first_documents(ids, np.array([0, 13, 26]), np.array([7, 5, 6]))
    assert first.tolist() == [6, 5, 6]


@pytest.mark.parametrize("long_list,hubs", [(neardup.LONG_LIST, neardup.HUBS), (3, 1)])
def test_near_duplicates_equal_brute_force(spark, rows, monkeypatch, long_list, hubs):
    monkeypatch.setattr(neardup, "LONG_LIST", long_list)
    monkeypatch.setattr(neardup, "HUBS", hubs)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = near_components([r[:2] for r in rows])
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
            assert r.n_shingles == len(shingles(texts[r.doc_id]))
    assert len({c for c in want.values()}) < len(want) - 30


def test_near_duplicates_with_several_long_texts_under_one_id(spark):
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10**9)}" for _ in range(400)]
    near = lambda t, k: [*t[:k], "other", *t[k + 1:]]
    p, q, r, x, y, z = (text() for _ in range(6))
    rows = [(1, p), (1, q), (2, near(p, 50)), (3, near(q, 70)), (4, near(p, 90)), (5, near(q, 110)),
            (9, p), (9, r), (12, near(r, 30)), (20, x), (21, y), (22, z), (23, x), (23, y), (23, z)]
    rows = [(k, " ".join(t)) for k, t in rows]
    want = near_components(rows)
    assert set(want.values()) == {1, 20}
    got = neardup.near_duplicates(spark.createDataFrame([*rows, (1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(g.doc_id, g.component_id) for g in got if g.n_shingles} == set(want.items())


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    links = path + [(500, k) for k in range(501, 540)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 540)} | {7: 7, 8: 7, 9: 7}
    assert got == want


def test_estimates_are_exact_for_whole_sets():
    a, b = np.arange(1, 31, dtype=np.uint64), np.arange(4, 34, dtype=np.uint64)
    pad = lambda x: np.r_[x, np.full(neardup.K - len(x), neardup.NO_VALUE)][None]
    assert neardup.estimates(pad(a), pad(b), np.array([False]))[0] == pytest.approx(27 / 33)


def test_words_cut_at_ascii_space_only():
    assert words("x y z\x1cw") == ["x y".encode(), b"z\x1cw"]
