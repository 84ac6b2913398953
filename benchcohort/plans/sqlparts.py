"""DuckDB building blocks for the oracle SQL (independent of the Spark code).

The oracle recomputes every query from the raw tables with plain SQL; these
helpers only keep the long shared CTEs (inputs, scorecard, exact interval)
in one place.
"""

from __future__ import annotations

from ..functions.binomial import STEPS
from ..functions.rules import (CANONICAL_MODEL_RULES, IMPROVEMENT_PATTERN, MODEL_CLEAN_RULES,
                               assign_rules_sql, replace_rules_sql)
from .inputs import CASES_SQL


def binomial_ci_ctes(src: str, keys: list[str], x: str = "x", n: str = "n",
                     name: str = "ci", conf: float = 0.95) -> str:
    """Recursive bisection for the Clopper-Pearson limits (lgamma terms)."""
    half = (1.0 - conf) / 2.0
    k = ", ".join(keys)

    def tail(lo_k: str, hi_k: str, p: str) -> str:
        return (f"list_sum(list_transform(range({lo_k}, {hi_k} + 1), lambda kk: "
                f"exp(lgamma({n} + 1) - lgamma(kk + 1) - lgamma({n} - kk + 1) "
                f"+ kk * ln({p}) + ({n} - kk) * ln(1 - {p}))))")

    m1 = "((lo1 + hi1) / 2)"
    m2 = "((lo2 + hi2) / 2)"
    t1 = tail(x, n, m1)
    t2 = tail("0", x, m2)
    return f"""{name}_bis({k}, {x}, {n}, i, lo1, hi1, lo2, hi2) AS (
  SELECT {k}, {x}, {n}, 0, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM {src}
  UNION ALL
  SELECT {k}, {x}, {n}, i + 1,
         CASE WHEN {t1} < {half} THEN {m1} ELSE lo1 END,
         CASE WHEN {t1} < {half} THEN hi1 ELSE {m1} END,
         CASE WHEN {t2} > {half} THEN {m2} ELSE lo2 END,
         CASE WHEN {t2} > {half} THEN hi2 ELSE {m2} END
  FROM {name}_bis WHERE i < {STEPS}
),
{name} AS (
  SELECT {k},
         CASE WHEN {n} <= 0 THEN NULL WHEN {x} <= 0 THEN 0.0 ELSE (lo1 + hi1) / 2 END AS lcl,
         CASE WHEN {n} <= 0 THEN NULL WHEN {x} >= {n} THEN 1.0 ELSE (lo2 + hi2) / 2 END AS ucl
  FROM {name}_bis WHERE i = {STEPS}
)"""


def canonical_sql(raw: str) -> str:
    return assign_rules_sql(raw, CANONICAL_MODEL_RULES,
                            otherwise=f"regexp_replace({raw}, '{IMPROVEMENT_PATTERN}', '')")


def improvement_sql(raw: str) -> str:
    return f"regexp_extract({raw}, '{IMPROVEMENT_PATTERN}', 0)"


def label_sql(imp: str) -> str:
    return (f"(upper(substr(trim(replace({imp}, '-', ' ')), 1, 1)) || "
            f"regexp_extract({imp}, '[0-9]+$', 0))")


def scorecard_ctes(score_rows_cte: str) -> str:
    """CTEs turning score rows (Bench, Model_Orig, n, Center, L95, U95,
    limits_not_ci) into the full scorecard ``sc``."""
    return f"""named AS (
  SELECT *, {improvement_sql('Model_Orig')} AS Improve,
         trim({canonical_sql('Model_Orig')} || {improvement_sql('Model_Orig')}) AS Model
  FROM {score_rows_cte}
),
flagged AS (
  SELECT *,
    MAX(Center) OVER (PARTITION BY Bench) AS Center_Best,
    CASE WHEN Center = MAX(Center) OVER (PARTITION BY Bench) THEN 1 ELSE 0 END AS Best,
    CASE WHEN Center < FIRST_VALUE(L95) OVER (PARTITION BY Bench ORDER BY Center DESC NULLS LAST, Model
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) THEN 1 ELSE 0 END AS Worse,
    CASE WHEN contains(lower(Model), 'llama') THEN 1 ELSE 0 END AS Meta
  FROM named
),
flagged2 AS (
  SELECT *, CASE WHEN Meta = 1 AND Center = MAX(CASE WHEN Meta = 1 THEN Center END) OVER (PARTITION BY Bench)
              THEN 1 ELSE 0 END AS BestMeta
  FROM flagged
),
improved AS (
  SELECT Bench, Model, Center, Improve, replace(Model, Improve, '') AS Base FROM flagged2 WHERE Improve <> ''
),
matched AS (
  SELECT i.Bench, i.Model, i.Base, b.Center AS Center_Base, b.L95 AS L95_Base, b.U95 AS U95_Base,
         CASE WHEN i.Center > b.U95 THEN 'Better' WHEN i.Center < b.L95 THEN 'Worse' ELSE 'Same' END AS Progress,
         {label_sql('i.Improve')} AS Improve_Label
  FROM improved i JOIN flagged2 b ON i.Bench = b.Bench AND i.Base = b.Model
),
compared AS (
  SELECT f.*, m.Base, m.Center_Base, m.L95_Base, m.U95_Base, m.Progress, m.Improve_Label,
         regexp_replace(f.Improve, '[0-9]+', '', 'g') AS Improve_Type
  FROM flagged2 f LEFT JOIN matched m ON f.Bench = m.Bench AND f.Model = m.Model
),
sc AS (
  SELECT *, CASE WHEN Base IS NOT NULL AND Improve = MAX(Improve) OVER (PARTITION BY Bench, Base, Improve_Type)
           THEN 1 ELSE 0 END AS Improve_Last
  FROM compared
)"""


def cases_scorecard_sql_ctes() -> str:
    clean = replace_rules_sql("raw_model", MODEL_CLEAN_RULES["cases"])
    return f"""WITH RECURSIVE cases AS ({CASES_SQL}),
case_units AS (SELECT bench, case_id, score, {clean} AS model_clean FROM cases),
case_agg AS (
  SELECT bench AS Bench, model_clean AS Model_Orig, CAST(COUNT(score) AS BIGINT) AS n,
         CAST(SUM(score) AS BIGINT) AS x
  FROM case_units GROUP BY bench, model_clean
),
{binomial_ci_ctes('case_agg', ['Bench', 'Model_Orig'], name='case_ci')},
score_rows AS (
  SELECT a.Bench, a.Model_Orig, a.n, a.x, a.x / a.n AS Center, c.lcl AS L95, c.ucl AS U95, 0 AS limits_not_ci
  FROM case_agg a JOIN case_ci c ON a.Bench = c.Bench AND a.Model_Orig = c.Model_Orig
),
{scorecard_ctes('score_rows')}"""
