"""The stats-file stream ingests run folders incrementally (exactly once,
across restarts) and yields the same scorecard as a batch scan."""

import tempfile

from pyspark.sql import functions as F

from benchcohort.operators.benchrows import medhelm_score_rows
from benchcohort.operators.scorecard import build_scorecard
from benchcohort.operators.stats import stat_records
from benchcohort.plans.inputs import rubric
from benchcohort.sources.files import read_stat_files, write_stat_files
from benchcohort.streaming.stat_stream import start_scorecard_stream

from .conftest import SF_SMALL


def _records(spark):
    items = rubric(spark, SF_SMALL)
    # Runs named like benchmark runs: two binomial and one rescaled benchmark.
    bench = (F.when(F.col("run_id") == "r0", "medhallu").when(F.col("run_id") == "r1", "pubmed_qa")
              .otherwise("medi_qa"))
    pert = F.when(F.col("axis") == "a1", "robustness").when(F.col("axis") == "a2", "fairness")
    items = items.withColumn("bench", bench)
    return stat_records(items, ["bench", "model"], {"exact_match": F.col("criterion_met")}, pert)


def test_stream_matches_batch(spark):
    work = tempfile.mkdtemp(prefix="bc-stream-")
    landing = f"{work}/landing"
    rec = _records(spark)
    first = rec.filter(F.col("bench") != "medi_qa")
    second = rec.filter(F.col("bench") == "medi_qa")
    rows, card, ckpt = (f"{work}/{x}" for x in ("rows", "card", "ckpt"))
    n1 = write_stat_files(spark, first, landing, "bench", "model", provider="prov")
    start_scorecard_stream(spark, landing, rows, card, ckpt).awaitTermination()
    n2 = write_stat_files(spark, second, landing, "bench", "model", provider="prov")
    start_scorecard_stream(spark, landing, rows, card, ckpt).awaitTermination()
    start_scorecard_stream(spark, landing, rows, card, ckpt).awaitTermination()  # nothing new: no duplicates
    key = lambda r: (r.Bench, r.Model, round(r.Center, 9), r.Best, r.Worse, r.BestMeta)
    streamed = sorted(key(r) for r in spark.read.parquet(card).collect())
    batch = sorted(key(r) for r in build_scorecard(medhelm_score_rows(read_stat_files(spark, landing))).collect())
    assert len(streamed) == n1 + n2 > 0
    assert streamed == batch
