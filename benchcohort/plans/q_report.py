"""The full scorecard: every benchmark source stacked (U2) and scored
together, as the reference's main report does — rubric rows with bootstrap
limits (T2), judged-case rows with bootstrap distributions (T1), MedHELM-style
rows (exact or rescaled limits) and badge rows (exact limits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import MODEL_CLEAN_RULES, replace_rules_sql
from ..operators import intervals, rubric
from ..operators.scorecard import build_scorecard, clean_model
from .inputs import CASES_SQL, cases
from .q_rubric import GROUPING_SQL, R_CASES, R_RUBRIC, SEED, _multinomial_sql, _title_sql, latest_grouped
from .q_sources import _BADGE_SQL_CTES, _RESCALED_SQL_CTES, _badge_scores_rows, _rescaled
from .registry import query, r6
from .sqlparts import scorecard_ctes

OUT = ["Bench", "Model", "Model_Orig", "Improve", "n", "Center", "L95", "U95", "limits_not_ci", "Center_Best",
       "Best", "Worse", "Meta", "BestMeta", "Base", "Center_Base", "L95_Base", "U95_Base", "Progress",
       "Improve_Label", "Improve_Type", "Improve_Last"]
ROUNDED = {"Center", "L95", "U95", "Center_Best", "Center_Base", "L95_Base", "U95_Base"}


def score_rows(spark, sf):
    # Rubric: T2 bootstrap per (model, run, group); the bench label is the group title.
    scores = latest_grouped(spark, sf)
    hb = intervals.bootstrap_mean_ci(scores, ["model", "run_id", "grp"], "conversation_id", "score", R_RUBRIC, SEED)
    hb = hb.select(rubric.bench_title(F.col("grp")).alias("Bench"), F.col("model").alias("Model_Orig"), "n",
                   F.col("mean").alias("Center"), F.col("lcl").alias("L95"), F.col("ucl").alias("U95"))
    # Judged cases: per (model, case) accuracy, then T1 bootstrap per model.
    cs = cases(spark, sf).withColumn("Model_Orig", clean_model(F.col("raw_model"), "cases"))
    acc = rubric.case_accuracy(cs, "Model_Orig")
    cpc = intervals.bootstrap_distribution(acc, ["Model_Orig"], "case_id", "correct", R_CASES, SEED)
    cpc = cpc.select(F.lit("CPC").alias("Bench"), "Model_Orig", "n", "Center", "L95", "U95")
    med = _rescaled(spark, sf).select("Bench", "Model_Orig", "n", "Center", "L95", "U95", "limits_not_ci")
    awe = _badge_scores_rows(spark, sf).select("Bench", "Model_Orig", "n", "Center", "L95", "U95")
    rows = hb.unionByName(cpc, allowMissingColumns=True).unionByName(med, allowMissingColumns=True) \
             .unionByName(awe, allowMissingColumns=True)
    # Sources without the flag are intervals, not fixed limits (limits_not_ci 0).
    return rows.withColumn("limits_not_ci", F.coalesce(F.col("limits_not_ci"), F.lit(0)))


def _sql() -> str:
    clean_cases = replace_rules_sql("raw_model", MODEL_CLEAN_RULES["cases"])
    hb = _multinomial_sql("scores", ["model", "run_id", "grp"], "score", R_RUBRIC, SEED,
                          drop_null=True, prefix="hb")
    cp = _multinomial_sql("cp_acc", ["Model_Orig"], "correct", R_CASES, SEED, drop_null=False,
                          prefix="cp")
    rubric_ctes = GROUPING_SQL.replace("WITH ", "", 1)
    return (_RESCALED_SQL_CTES + ",\n" + _BADGE_SQL_CTES.replace("WITH RECURSIVE ", "") + ",\n" + rubric_ctes
            + f""",
{hb},
hb_rows AS (
  SELECT {_title_sql('s.grp')} AS Bench, s.model AS Model_Orig, CAST(s.n_nonnull AS BIGINT) AS n,
         s.mean_v AS Center, q.q025 AS L95, q.q975 AS U95, 0 AS limits_not_ci
  FROM hb_sizes s JOIN hb_q q ON s.model = q.model AND s.run_id = q.run_id AND s.grp = q.grp
),
cp_cases AS ({CASES_SQL}),
cp_acc AS (SELECT {clean_cases} AS Model_Orig, case_id, AVG(CASE WHEN score IS NULL THEN 0 ELSE score END) AS correct
           FROM cp_cases GROUP BY 1, 2),
{cp},
cp_rows AS (
  SELECT 'CPC' AS Bench, s.Model_Orig, CAST(s.n_nonnull AS BIGINT) AS n, q.q50 AS Center, q.q025 AS L95,
         q.q975 AS U95, 0 AS limits_not_ci
  FROM cp_sizes s JOIN cp_q q ON s.Model_Orig = q.Model_Orig
),
med_rows AS (
  SELECT 'MedHELM: ' || w2.b || CASE WHEN is_bin THEN '' ELSE ' (rescale, max=5)' END AS Bench, w2.Model_Orig,
         w2.n, w2.Center,
         CASE WHEN is_bin THEN c.lcl ELSE w2.Center - 0.025 END AS L95,
         CASE WHEN is_bin THEN c.ucl ELSE w2.Center + 0.025 END AS U95,
         CASE WHEN is_bin THEN 0 ELSE 1 END AS limits_not_ci
  FROM w2 JOIN rci c ON w2.b = c.b AND w2.Model_Orig = c.Model_Orig
),
awe_rows AS (
  SELECT b.Bench, b.Model_Orig, b.n, b.Center, c.lcl AS L95, c.ucl AS U95, 0 AS limits_not_ci
  FROM b2 b JOIN bci c ON b.Bench = c.Bench AND b.Model_Orig = c.Model_Orig
),
all_rows AS (
  SELECT * FROM hb_rows UNION ALL SELECT * FROM cp_rows UNION ALL SELECT * FROM med_rows
  UNION ALL SELECT * FROM awe_rows
),
{scorecard_ctes('all_rows')}
SELECT {", ".join(f"round({c}, 6) AS {c}" if c in ROUNDED else c for c in OUT)} FROM sc""")


@query("full_scorecard", sql=_sql())
def full_scorecard(spark, sf):
    sc = build_scorecard(score_rows(spark, sf), materialize=True)
    return sc.select(*[r6(c) if c in ROUNDED else F.col(c) for c in OUT])
