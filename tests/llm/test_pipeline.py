"""The pipeline, each stage against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from benchcohort.llm.common import scratch_path
from benchcohort.llm.mixing import mix
from benchcohort.llm.q_classify import THRESHOLD, trained_quality
from benchcohort.llm.quality import score_quality

from ..conftest import SF_SMALL
from .data import SCHEMA, documents, near_components, substring_kept


@pytest.fixture(scope="module")
def steps(spark):
    """Input of each stage, and the last output; with columns whose names clash."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("score", F.lit(1)).withColumn("kept", F.lit("x")) \
        .withColumn("size", F.lit(2))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test")
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "substring dedup", "source mix", "bpe"]


def test_quality_stage_drops_what_the_classifier_rejects(spark, steps):
    model = trained_quality(spark, steps[0], SF_SMALL)
    want = {r.doc_id for r in score_quality(steps[0].select("doc_id", "text"), model).collect() if r.score >= THRESHOLD}
    assert {k for k, _ in pairs(steps[1])} == want and 0 < len(want) < steps[0].count()


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    found = near_components(pairs(steps[1]))
    assert sorted(k for k, _ in pairs(steps[2])) == sorted(set(found.values()))


def test_substring_stage_cuts_repeated_passages(steps):
    before = dict(pairs(steps[2]))
    want = {k: t if gone else before[k] for k, _, gone, t in substring_kept(list(before.items()))}
    assert dict(pairs(steps[3])) == want
    assert all(r.n_chars == len(r.text) for r in steps[3].collect() if r.text != before[r.doc_id])


def test_mix_stage_repeats_documents(steps):
    copies = {r.doc_id: r.copies for r in mix(steps[3]).collect()}
    got = {}
    for k, _ in pairs(steps[4]):
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    assert dict(pairs(steps[4])).items() <= dict(pairs(steps[3])).items()


def test_last_stage_encodes_every_copy(steps):
    assert steps[5].count() == steps[4].count()
    assert all(r.n_tokens == len(r.ids.split()) for r in steps[5].collect())


def test_stages_handle_awkward_and_no_documents(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for start in (docs, docs.limit(0)):
        rows = start
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_SMALL)
        assert (rows.count() > 0) == (start.count() > 0)
