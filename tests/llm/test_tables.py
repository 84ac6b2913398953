"""Mixing, URL lists and classifiers; queries with SQL against DuckDB."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchcohort.llm.langid import fit_centroids, identify
from benchcohort.llm.mixing import mix
from benchcohort.llm.q_classify import fold
from benchcohort.llm.quality import (cuts_of, descend, fit_quality, keep_quality, prior_of, pu_gradient, pu_risk, reaching,
                                     score_quality)
from benchcohort.llm.queries import ORACLES, QUERIES
from benchcohort.llm.urlfilter import host_of, temporal_list_join
from benchcohort.plans.check import compare, oracle_connection

from ..conftest import SF_CHECK, SF_SMALL
from .data import SCHEMA, documents, words


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    ok, why = compare(QUERIES[name](spark, SF_SMALL), oracle_connection(SF_SMALL), ORACLES[name])
    assert ok, why


def water_filled(sizes, weights, share, most):
    """Targets by repeated resharing."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if level * weights[k] >= most * sizes[k]}
        if not full:
            for k in open_:
                target[k] = level * weights[k]
            break
        for k in full:
            target[k] = most * sizes[k]
            left -= target[k]
        open_ -= full
    return target


def test_mix_reaches_capped_targets(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(1)).withColumn("target", F.lit("x"))
    out = mix(docs).collect()
    assert len(out) == len(rows)
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources]
    targets = dict(zip(sizes, water_filled(sizes, [5, 2, 1, 5], 1.5, 2.0)))
    taken = {}
    for r in out:
        assert r.target == pytest.approx(targets[r.source_size])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    largest = max(len(words(r[1])) for r in rows)
    assert all(abs(taken[s] - t) <= largest / 2 + 1 for s, t in targets.items())
    again = {(r.doc_id, r["size"], r.taken) for r in mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r["size"], r.taken) for r in out}
    assert mix(docs.limit(0)).count() == 0


def test_list_entries_hold_from_their_day_to_the_next_change(spark):
    log = spark.createDataFrame(
        [("bad.com", "block", 10, 0), ("bad.com", "remove", 20, 0), ("ok.bad.com", "allow", 12, 0), ("bad.com/x", "allow", 0, 0),
         ("bad.com", "allow", 30, 0), ("bad.com", "block", 30, 1), (None, "block", 0, 0), ("n.org", None, 0, 0),
         ("n.org", "block", None, 0)], "key string, verdict string, day int, seq int")
    asked = [("http://bad.com/", 9, "none"), ("https://u:p@BAD.com.:80?q", 10, "block"), ("http://a.bad.com", 19, "block"),
             ("http://bad.com", 20, "none"), ("http://x.ok.bad.com/y", 11, "block"), ("http://x.ok.bad.com/y", 12, "allow"),
             ("http://bad.com/x/1", 15, "allow"), ("http://bad.com/xx", 15, "block"), ("http://bad.com", 31, "block"),
             ("http://notbad.com", 15, "none"), (None, 15, "none"), ("no url", 15, "none"), ("http://bad.com", None, "none"),
             ("http://n.org", 5, "none"), ("http://com", 5, "none"), ("http://bad.com", 15, "block"), ("http://bad.com", 15, "block")]
    captures = spark.createDataFrame([(*a, k) for k, a in enumerate(asked)], "url string, fetch_day int, rank string, key int")
    got = {r.key: r.verdict for r in temporal_list_join(captures, log).collect()}
    assert got == {k: a[2] for k, a in enumerate(asked)}
    assert temporal_list_join(captures, log.limit(0)).filter("verdict <> 'none'").count() == 0
    assert temporal_list_join(captures.limit(0), log).count() == 0
    plan = temporal_list_join(captures, log)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert spark.range(1).select(host_of(F.lit("ftp://[::1]:21/x")).alias("h")).first().h == "[::1]"


def held_out(spark, name, label, value):
    truth = spark.read.parquet(f"{SF_CHECK}/{label[0]}.parquet").select("doc_id", label[1])
    rows = QUERIES[name](spark, SF_CHECK).filter("held_out").join(truth, "doc_id").dropna(subset=[label[1]]).collect()
    return np.mean([r[value] == r[label[1]] for r in rows]), len(rows)


def test_quality_on_held_out_documents(spark):
    accuracy, n = held_out(spark, "op6_quality", ("labels", "quality"), "predicted")
    assert n > 40 and accuracy >= 0.95


def test_language_on_held_out_documents(spark):
    accuracy, n = held_out(spark, "op7_language", ("documents", "lang"), "lang_pred")
    assert n > 200 and accuracy >= 0.97


def test_classifiers_handle_awkward_rows(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    few = spark.createDataFrame([(0,), (1,)], "doc_id long")
    model = fit_quality(docs, few)
    scored = score_quality(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert keep_quality(docs, model, 0.0).count() == len(rows) and keep_quality(docs, model, 2.0).count() == 0
    assert score_quality(docs.limit(0), model).count() == 0
    found = identify(docs, fit_centroids(docs)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for k, t, *_ in rows if k == r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r.score <= 1
    nothing = identify(docs, fit_centroids(docs.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_prior_is_found_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, (3000, 4))
    u = np.r_[rng.normal(2, 1, (1800, 4)), rng.normal(-2, 1, (1200, 4))]
    u = rng.permutation(u)
    theta = descend(p[::2], u[::2], None, 150)
    scores = lambda x: x @ theta[:-1] + theta[-1]
    cuts = cuts_of(scores(p[1::2]))
    shares = [reaching(scores(x[1::2]), cuts) / len(x[1::2]) for x in (p, u)]
    assert prior_of(*shares) == pytest.approx(0.6, abs=0.08)


def test_gradient_is_the_slope_of_the_non_negative_risk():
    rng = np.random.default_rng(4)
    for prior, shift in ((0.3, 0.0), (0.8, 0.0), (0.6, 3.0)):
        p, u = rng.normal(1 + shift, 1, (40, 3)), rng.normal(0, 1, (70, 3))
        theta = rng.normal(size=4)
        z = lambda x: x @ theta[:-1] + theta[-1]
        plus, minus = (lambda x: np.mean(np.log1p(np.exp(-z(x))))), (lambda x: np.mean(np.log1p(np.exp(z(x)))))
        rest = minus(u) - prior * minus(p)
        assert pu_risk(theta, p, u, prior) == pytest.approx(prior * plus(p) + max(rest, 0))
        # below zero the negative risk is pushed back up, whatever the rest
        value = (lambda t: pu_risk(t, p, u, prior)) if rest >= 0 else (
            lambda t: prior * np.logaddexp(0, p @ t[:-1] + t[-1]).mean() - np.logaddexp(0, u @ t[:-1] + t[-1]).mean())
        slope = [(value(theta + e) - value(theta - e)) / 2e-6 for e in 1e-6 * np.eye(4)]
        assert pu_gradient(theta, p, u, prior) == pytest.approx(np.array(slope), abs=1e-6)


def test_statistics_of_the_quality_model_cover_all_documents(spark, monkeypatch):
    """Means and scales are those of all texts, however small the samples are."""
    from benchcohort.llm import quality
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(quality, "FIT_UNLABELLED", 8)
    monkeypatch.setattr(quality, "FIT_POSITIVE", 4)
    model = fit_quality(docs, docs.select("doc_id").filter("doc_id % 3 = 0"))
    all_features = quality.describe([(r[1] or "").encode() for r in rows]).astype(np.float64)
    assert model.mean == pytest.approx(all_features.mean(0), abs=1e-6)
    assert model.scale == pytest.approx(all_features.std(0) + 1e-3, abs=1e-5)


def test_ids_that_very_many_rows_share_are_fitted_on_once(spark):
    docs = spark.createDataFrame([(7, f"text {k} and more words", "en") for k in range(300)] + [(None, f"ein Satz {k}", "de") for k in range(300)]
                                 + [(k, f"other {k} words", "en") for k in range(10, 14)], "doc_id long, text string, lang string")
    model = fit_quality(docs, docs.select("doc_id").filter("doc_id >= 10"))
    assert len(score_quality(docs, model).collect()) == 604
    found = identify(docs, fit_centroids(docs)).collect()
    assert {r.lang_pred for r in found if r.doc_id is None} == {"de"}


def test_stages_and_list_join_take_any_column_names(spark):
    from benchcohort.llm import stages
    rows = [(k, f"some words of text {k % 3} " * 9, "s", k) for k in range(6)] + [(None, None, None, 9)]
    names = ["dropped_", "taken_", "copies_", "copy_", "best_", "host", "verdict", "doc_id_", "kept", "c0_", "size"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    kept = stages.drop_near_duplicates(spark, docs, "")
    mixed = stages.mix_sources(spark, docs, "")
    assert kept.columns == mixed.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [0, 1, 2, 9]
    assert all(r[n] == n for df in (kept, mixed) for r in df.collect() for n in names)
    log = spark.createDataFrame([("a.com", "block", 1, 0)], "key string, verdict string, day int, seq int")
    captures = spark.createDataFrame([("http://a.com/x", 5, "mine", "own", "b", 1)], "url string, fetch_day int, host string, verdict string, best_ string, day_ int")
    out = temporal_list_join(captures, log)
    assert out.columns == [*captures.columns, "host_", "segment", "list_key", "valid_from", "verdict_"]
    r = out.first()
    assert (r.host, r.verdict, r.best_, r.day_, r.host_, r.verdict_) == ("mine", "own", "b", 1, "a.com", "block")


def test_folds_follow_the_checksum_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
