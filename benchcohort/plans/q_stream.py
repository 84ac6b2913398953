"""Streaming ingestion in the catalogue: stats files derived from the events
table land in two arrivals; the file stream ingests each once and keeps the
scorecard current. The oracle recomputes the same scorecard from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..operators.rubric import cleaned
from ..session import scratch_path
from ..sources import files
from ..streaming.stat_stream import start_scorecard_stream
from .inputs import RUBRIC_SQL, rubric
from .q_sources import _CLEAN_RUBRIC
from .registry import query, r6
from .sqlparts import binomial_ci_ctes, scorecard_ctes

OUT = ["Bench", "Model", "n", "Center", "L95", "U95", "limits_not_ci", "Best", "Worse", "BestMeta", "Base",
       "Progress", "Improve_Last"]
ROUNDED = {"Center", "L95", "U95"}


def _records(spark, sf):
    items = cleaned(rubric(spark, sf))
    # Each rubric run becomes one benchmark: two proportion-scored, one 0-5 scored.
    bench = (F.when(F.col("run_id") == "r0", "medhallu").when(F.col("run_id") == "r1", "pubmed_qa")
              .otherwise("medi_qa"))
    pert = F.when(F.col("axis") == "a1", "robustness").when(F.col("axis") == "a2", "fairness")
    scaled = F.when(F.col("run_id") == "r2", F.col("criterion_met") * F.lit(5.0)).otherwise(F.col("criterion_met"))
    return stats.stat_records(items.withColumn("bench", bench), ["bench", "model"], {"exact_match": scaled}, pert)


def _sql() -> str:
    return f"""WITH RECURSIVE rubric_raw AS ({RUBRIC_SQL}),
rb AS (SELECT * REPLACE ({_CLEAN_RUBRIC} AS model) FROM rubric_raw),
st AS (
  SELECT CASE run_id WHEN 'r0' THEN 'medhallu' WHEN 'r1' THEN 'pubmed_qa' ELSE 'medi_qa' END AS bench, model,
         CASE axis WHEN 'a1' THEN 'robustness' WHEN 'a2' THEN 'fairness' END AS pert,
         CASE WHEN run_id = 'r2' THEN criterion_met * 5.0 ELSE criterion_met END AS x
  FROM rb
),
rec AS (
  SELECT bench, model, pert, COUNT(x) AS cnt,
         CAST(SUM(CAST(round(x * 100.0) AS DECIMAL(38,0))) AS DOUBLE) AS s1
  FROM st GROUP BY bench, model, pert
),
best AS (
  SELECT bench, model, MAX(CASE WHEN pert = 'robustness' THEN s1 / cnt / 100.0 END) AS val FROM rec GROUP BY bench, model
),
w2 AS (
  SELECT bench, replace(regexp_replace(model, 'databricks-', '', 'g'), '-rag', '-multi') AS Model_Orig,
         bench IN ('medhallu', 'pubmed_qa') AS is_bin, val,
         CASE WHEN bench IN ('medhallu', 'pubmed_qa') THEN val ELSE val / 5.0 END AS Center,
         CAST(1000 AS BIGINT) AS n, CAST(round_even(val * 1000, 0) AS BIGINT) AS x
  FROM best
),
{binomial_ci_ctes('w2', ['bench', 'Model_Orig'], name='sci')},
rows_ AS (
  SELECT 'MedHELM: ' || w2.bench || CASE WHEN is_bin THEN '' ELSE ' (rescale, max=5)' END AS Bench, w2.Model_Orig,
         w2.n, w2.Center,
         CASE WHEN is_bin THEN c.lcl ELSE w2.Center - 0.025 END AS L95,
         CASE WHEN is_bin THEN c.ucl ELSE w2.Center + 0.025 END AS U95,
         CASE WHEN is_bin THEN 0 ELSE 1 END AS limits_not_ci
  FROM w2 JOIN sci c ON w2.bench = c.bench AND w2.Model_Orig = c.Model_Orig
),
{scorecard_ctes('rows_')}
SELECT {", ".join(f"round({c}, 6) AS {c}" if c in ROUNDED else c for c in OUT)} FROM sc"""


@query("stream_scorecard", sql=_sql())
def stream_scorecard(spark, sf):
    work = scratch_path(spark, "stream")
    landing, rows, card, ckpt = (f"{work}/{x}" for x in ("landing", "rows", "card", "ckpt"))
    rec = _records(spark, sf)
    for arrival in (F.col("bench") != "medi_qa", F.col("bench") == "medi_qa"):
        files.write_stat_files(spark, rec.filter(arrival), landing, "bench", "model", provider="prov")
        start_scorecard_stream(spark, landing, rows, card, ckpt).awaitTermination()
    return spark.read.parquet(card).select(*[r6(c) if c in ROUNDED else F.col(c) for c in OUT])
