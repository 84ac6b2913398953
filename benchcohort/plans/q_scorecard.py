"""Scorecard queries over V_cases (exact binomial scoring, flags, base
comparison, report filters and chart layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import report
from ..operators.scorecard import (binomial_scores, canonical_base, cases_scorecard, clean_model,
                                   improvement_label, improvement_type, legend_symbol, with_model_names)
from .inputs import CASES_SQL, cases
from .registry import query, r6
from .sqlparts import canonical_sql, cases_scorecard_sql_ctes, improvement_sql, label_sql

SC = cases_scorecard_sql_ctes()

# Report parameters (the reference's run configuration, applied to V_cases).
EXCLUDE = ["Llama 3.3 70B-Prompt2", "o3"]
DOWN_TO = "Llama 4 Maverick"
INCLUDE_ONE = "Llama 4 Maverick"
FOCUS_FAMILY = "Maverick"


def _sc(spark: SparkSession, sf: str) -> DataFrame:
    return cases_scorecard(cases(spark, sf))


@query("binomial_ci", sql=SC + """
SELECT Bench, Model, n, x, Center, round(L95, 6) AS L95, round(U95, 6) AS U95, limits_not_ci FROM sc""")
def binomial_ci(spark, sf):
    units = cases(spark, sf).withColumn("Model_Orig", clean_model(F.col("raw_model"), "cases"))
    rows = with_model_names(binomial_scores(units, "bench", "Model_Orig", "score"))
    return rows.select("Bench", "Model", "n", "x", "Center", r6("L95"), r6("U95"), "limits_not_ci")


@query("flag_best_worse", sql=SC + """
SELECT Bench, Model, Center, Center_Best, Best, Worse FROM sc""")
def flag_best_worse(spark, sf):
    return _sc(spark, sf).select("Bench", "Model", "Center", "Center_Best", "Best", "Worse")


@query("flag_family_best", sql=SC + """
SELECT Bench, Model, Center, Meta, BestMeta FROM sc""")
def flag_family_best(spark, sf):
    return _sc(spark, sf).select("Bench", "Model", "Center", "Meta", "BestMeta")


@query("progress_vs_base", sql=SC + """
SELECT Bench, Model, Improve, Base, Center, Center_Base, round(L95_Base, 6) AS L95_Base,
       round(U95_Base, 6) AS U95_Base, Progress, Improve_Label FROM sc""")
def progress_vs_base(spark, sf):
    return _sc(spark, sf).select("Bench", "Model", "Improve", "Base", "Center", "Center_Base",
                                 r6("L95_Base"), r6("U95_Base"), "Progress", "Improve_Label")


@query("base_semi_join", sql=SC + """
SELECT Bench, Model, Center FROM sc
WHERE Model IN (SELECT replace(Model, Improve, '') FROM sc WHERE Improve <> '')""")
def base_semi_join(spark, sf):
    sc = _sc(spark, sf)
    bases = sc.filter(F.col("Improve") != "").select(
        F.replace(F.col("Model"), F.col("Improve"), F.lit("")).alias("Base"))
    return (sc.join(bases, sc["Model"] == bases["Base"], "left_semi")
              .select("Bench", "Model", "Center"))


@query("latest_improvement", sql=SC + """
SELECT Bench, Model, Base, Improve, Improve_Type, Improve_Last FROM sc""")
def latest_improvement(spark, sf):
    return _sc(spark, sf).select("Bench", "Model", "Base", "Improve", "Improve_Type", "Improve_Last")


@query("best_improvement_report", sql=SC + f"""
, focus AS (SELECT * FROM sc WHERE contains(Model, '{FOCUS_FAMILY}') AND Improve_Last = 1)
SELECT Bench, Base, Improve, n, Center, Center_Base, round(L95_Base, 6) AS L95_Base,
       round(U95_Base, 6) AS U95_Base, Center_Best, Best, Worse, BestMeta, Progress, limits_not_ci,
       round(CASE WHEN Center_Base = 0 THEN NULL ELSE 100 * (Center - Center_Base) / Center_Base END, 6) AS Improve_Pct
FROM focus
WHERE Center = (SELECT MAX(f2.Center) FROM focus f2 WHERE f2.Bench = focus.Bench AND f2.Base = focus.Base)""")
def best_improvement_report(spark, sf):
    return report.best_improvement(_sc(spark, sf), FOCUS_FAMILY).select(
        "Bench", "Base", "Improve", "n", "Center", "Center_Base", r6("L95_Base"), r6("U95_Base"),
        "Center_Best", "Best", "Worse", "BestMeta", "Progress", "limits_not_ci", r6("Improve_Pct"))


@query("showing_counts", sql=SC + """
, mins AS (SELECT Bench, MIN(Center) AS CenterMin FROM sc WHERE Model = 'o3' OR BestMeta = 1 GROUP BY Bench),
flagged_rows AS (
  SELECT s.Bench, s.Model, s.Center, CASE WHEN s.Center >= m.CenterMin THEN 1 ELSE 0 END AS keep
  FROM sc s JOIN mins m ON s.Bench = m.Bench
),
counts AS (SELECT Bench, SUM(keep) AS shown, COUNT(*) AS total FROM flagged_rows GROUP BY Bench)
SELECT f.Bench, f.Model, f.Center,
       CASE WHEN c.shown = c.total THEN '(Showing all ' || CAST(c.total AS VARCHAR) || ' models)'
            ELSE '(Showing ' || CAST(c.shown AS VARCHAR) || ' of ' || CAST(c.total AS VARCHAR) || ' models)' END AS Showing
FROM flagged_rows f JOIN counts c ON f.Bench = c.Bench
WHERE f.keep = 1""")
def showing_counts(spark, sf):
    return report.showing_counts(_sc(spark, sf)).select("Bench", "Model", "Center", "Showing")


@query("top1_per_group", sql=SC + """
SELECT Bench, Model, Center, round(L95, 6) AS L95 FROM (
  SELECT *, row_number() OVER (PARTITION BY Bench ORDER BY Center DESC NULLS LAST, Model) AS rn FROM sc
) WHERE rn = 1""")
def top1_per_group(spark, sf):
    w = Window.partitionBy("Bench").orderBy(F.col("Center").desc_nulls_last(), F.col("Model"))
    return (_sc(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
            .select("Bench", "Model", "Center", r6("L95")))


@query("top_n", sql=SC + """
SELECT Bench, Model, Center FROM sc ORDER BY Center DESC, Bench, Model LIMIT 5""")
def top_n(spark, sf):
    # A top-k report: the limit is the feature.
    return (_sc(spark, sf).orderBy(F.col("Center").desc(), "Bench", "Model").limit(5)
            .select("Bench", "Model", "Center"))


_EXCL_SQL = ", ".join(f"'{m.lower()}'" for m in EXCLUDE)


@query("filter_exclude", sql=SC + f"""
SELECT Bench, Model, Center FROM sc WHERE lower(Model) NOT IN ({_EXCL_SQL})""")
def filter_exclude(spark, sf):
    return report.exclude_models(_sc(spark, sf), EXCLUDE).select("Bench", "Model", "Center")


_REPORT_SQL = """
report_rows AS (
  SELECT * FROM sc
  WHERE (Improve = '' OR Best = 1 OR BestMeta = 1 OR Improve_Last = 1)
    AND NOT (Improve <> '' AND Improve_Last = 0)
)"""


@query("report_filter", sql=SC + "," + _REPORT_SQL + """
SELECT Bench, Model, Center, Improve, Best, BestMeta, Improve_Last FROM report_rows""")
def report_filter(spark, sf):
    rows = report.report_rows(_sc(spark, sf))
    # O1: bench ascending, Center descending (nulls last), as the report lists them.
    return (rows.orderBy("Bench", F.col("Center").desc_nulls_last(), "Model")
                .select("Bench", "Model", "Center", "Improve", "Best", "BestMeta", "Improve_Last"))


@query("floor_filter", sql=SC + f"""
, floor_rows AS (SELECT Bench, Center AS Min FROM sc WHERE Model = '{DOWN_TO}')
SELECT s.Bench, s.Model, s.Center FROM sc s JOIN floor_rows f ON s.Bench = f.Bench WHERE s.Center >= f.Min""")
def floor_filter(spark, sf):
    return report.floor_filter(_sc(spark, sf), DOWN_TO).select("Bench", "Model", "Center")


_LAYOUT_SQL = _REPORT_SQL + """,
bench_sizes AS (SELECT Bench, COUNT(*) AS cnt FROM report_rows GROUP BY Bench),
offsets AS (
  SELECT Bench, SUM(cnt + 1) OVER (ORDER BY Bench ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (cnt + 1) AS off,
         SUM(cnt + 1) OVER () AS total
  FROM bench_sizes
),
layout AS (
  SELECT o.Bench, CAST(NULL AS VARCHAR) AS Model, CAST(NULL AS DOUBLE) AS Center, 1 AS is_header,
         CAST(o.total - 1 - o.off AS BIGINT) AS y
  FROM offsets o
  UNION ALL
  SELECT r.Bench, r.Model, r.Center, 0 AS is_header,
         CAST(o.total - 1 - (o.off + row_number() OVER (PARTITION BY r.Bench ORDER BY r.Center DESC NULLS LAST, r.Model)) AS BIGINT) AS y
  FROM report_rows r JOIN offsets o ON r.Bench = o.Bench
)"""


@query("chart_layout", sql=SC + "," + _LAYOUT_SQL + """
SELECT Bench, Model, Center, is_header, y FROM layout""")
def chart_layout(spark, sf):
    return report.chart_layout(report.report_rows(_sc(spark, sf))).select(
        "Bench", "Model", "Center", "is_header", "y")


#: The default report: exclusions, bench patterns, improvement rule, the top of each bench.
REPORT = report.ReportOptions(exclude=EXCLUDE, bench=["de", "en", "fr"], reference_model="Llama 3.3 70B")

_REPORT_LAYOUT_SQL = f"""
chosen AS (
  SELECT * FROM sc WHERE lower(Model) NOT IN ({_EXCL_SQL}) AND regexp_matches(Bench, '{"|".join(REPORT.bench)}')
    AND (Improve = '' OR Best = 1 OR BestMeta = 1 OR Improve_Last = 1) AND NOT (Improve <> '' AND Improve_Last = 0)
),
floors AS (SELECT Bench, MIN(Center) AS least FROM chosen WHERE Model = '{REPORT.reference_model}' OR BestMeta = 1 GROUP BY Bench),
marked AS (SELECT c.*, CAST(c.Center >= f.least AS INTEGER) AS keep FROM chosen c JOIN floors f ON c.Bench = f.Bench),
shown AS (SELECT Bench, SUM(keep) AS k, COUNT(*) AS m FROM marked GROUP BY Bench),
places AS (
  SELECT Bench, k, CASE WHEN k = m THEN '(Showing all ' || m || ' models)' ELSE '(Showing ' || k || ' of ' || m || ' models)' END AS Showing,
         SUM(k + 1) OVER (ORDER BY Bench) - (k + 1) AS off, SUM(k + 1) OVER () AS total FROM shown
),
laid AS (
  SELECT Bench, CAST(NULL AS VARCHAR) AS Model, CAST(NULL AS DOUBLE) AS Center, CAST(NULL AS DOUBLE) AS L95, CAST(NULL AS DOUBLE) AS U95,
         CAST(NULL AS INTEGER) AS limits_not_ci, CAST(NULL AS INTEGER) AS Best, CAST(NULL AS INTEGER) AS Worse,
         CAST(NULL AS INTEGER) AS BestMeta, CAST(NULL AS VARCHAR) AS Improve, CAST(NULL AS DOUBLE) AS Center_Best, Showing,
         1 AS is_header, CAST(total - 1 - off AS BIGINT) AS y FROM places
  UNION ALL
  SELECT r.Bench, Model, Center, L95, U95, limits_not_ci, Best, Worse, BestMeta, Improve, Center_Best, NULL, 0,
         CAST(total - 1 - (off + row_number() OVER (PARTITION BY r.Bench ORDER BY Center DESC NULLS LAST, Model)) AS BIGINT)
  FROM marked r JOIN places p ON r.Bench = p.Bench WHERE keep = 1
)"""


@query("report_layout", sql=SC + "," + _REPORT_LAYOUT_SQL + """
SELECT Bench, Model, Center, round(L95, 6) AS L95, round(U95, 6) AS U95, limits_not_ci, Best, Worse, BestMeta, Improve, Center_Best,
       Showing, is_header, y FROM laid""")
def report_layout(spark, sf):
    """The default report in one: selection, counts shown, layout, all columns that are drawn."""
    out = report.report_layout(_sc(spark, sf), REPORT)
    return out.select("Bench", "Model", "Center", r6("L95"), r6("U95"), "limits_not_ci", "Best", "Worse", "BestMeta", "Improve",
                      "Center_Best", "Showing", "is_header", "y")


@query("overlay_best", sql=SC + "," + _REPORT_LAYOUT_SQL + """,
markers AS (
  SELECT l.Bench, l.Model, l.y, s.Center, s.Progress, s.Improve_Label,
         MAX(s.Center) OVER (PARTITION BY l.Bench, l.Model) AS top
  FROM laid l JOIN sc s ON l.Bench = s.Bench AND l.Model = s.Base WHERE s.Progress IS NOT NULL AND s.Improve_Last = 1
)
SELECT Bench, Model, y, Center, Progress, Improve_Label FROM markers WHERE Center = top""")
def overlay_best(spark, sf):
    """The best improvement on each row of the default report."""
    sc = _sc(spark, sf)
    out = report.overlay_markers(report.report_layout(sc, REPORT), sc, REPORT, best_only=True)
    return out.select("Bench", "Model", "y", "Center", "Progress", "Improve_Label")


@query("chart_layout_single", sql=SC + f"""
, one AS (SELECT Bench, Model, Center FROM sc WHERE lower(Model) = lower('{INCLUDE_ONE}'))
SELECT Bench, Model, Center, CAST(row_number() OVER (ORDER BY Center, Bench) AS BIGINT) AS y FROM one
UNION ALL
SELECT MIN(Model) AS Bench, CAST(NULL AS VARCHAR) AS Model, CAST(NULL AS DOUBLE) AS Center,
       CAST(COUNT(*) + 1 AS BIGINT) AS y FROM one HAVING COUNT(*) > 0""")
def chart_layout_single(spark, sf):
    return report.chart_layout_single(_sc(spark, sf), INCLUDE_ONE).select("Bench", "Model", "Center", "y")


@query("chart_overlay", sql=SC + "," + _LAYOUT_SQL + """
, overlay AS (
  SELECT Bench, Base AS Model, Center, Progress, Improve_Label FROM sc
  WHERE Progress IS NOT NULL AND Improve_Last = 1
)
SELECT l.Bench, l.Model, l.y, o.Center, o.Progress, o.Improve_Label
FROM layout l JOIN overlay o ON l.Bench = o.Bench AND l.Model = o.Model""")
def chart_overlay(spark, sf):
    sc = _sc(spark, sf)
    layout = report.chart_layout(report.report_rows(sc))
    return report.chart_overlay(layout, sc).select("Bench", "Model", "y", "Center", "Progress", "Improve_Label")


@query("model_map", sql=SC + """
SELECT DISTINCT Model_Orig, Model FROM sc""")
def model_map(spark, sf):
    return _sc(spark, sf).select("Model_Orig", "Model").distinct().orderBy("Model", "Model_Orig")


@query("canonical_model", sql=f"""
WITH cases AS ({CASES_SQL}),
names AS (SELECT DISTINCT raw_model, replace(raw_model, 'meta-llama/', '') AS model_clean FROM cases)
SELECT raw_model, model_clean, {canonical_sql('model_clean')} AS canonical,
       trim({canonical_sql('model_clean')} || {improvement_sql('model_clean')}) AS Model
FROM names""")
def canonical_model(spark, sf):
    names = cases(spark, sf).select("raw_model").distinct()
    names = names.withColumn("model_clean", clean_model(F.col("raw_model"), "cases"))
    return (with_model_names(names, "model_clean")
            .withColumn("canonical", canonical_base(F.col("model_clean")))
            .select("raw_model", "model_clean", "canonical", "Model"))


@query("improvement_tag", sql=f"""
WITH cases AS ({CASES_SQL})
SELECT raw_model, {improvement_sql('raw_model')} AS Improve,
       trim({canonical_sql('raw_model')} || {improvement_sql('raw_model')}) AS Model,
       CAST(COUNT(*) AS BIGINT) AS n_cases
FROM cases GROUP BY raw_model""")
def improvement_tag_q(spark, sf):
    agg = cases(spark, sf).groupBy("raw_model").agg(F.count(F.lit(1)).alias("n_cases"))
    return (with_model_names(agg, "raw_model")
            .select("raw_model", "Improve", "Model", "n_cases"))


@query("improvement_label", sql=SC + f"""
SELECT DISTINCT Improve, regexp_replace(Improve, '[0-9]+', '', 'g') AS Improve_Type,
       {label_sql('Improve')} AS Improve_Label,
       CASE WHEN NOT regexp_matches({label_sql('Improve')}, '[0-9]') THEN substr({label_sql('Improve')}, 1, 1) END
         AS Legend
FROM sc WHERE Improve <> ''""")
def improvement_label_q(spark, sf):
    sc = _sc(spark, sf).filter(F.col("Improve") != "")
    return (sc.select("Improve").distinct()
            .select("Improve", improvement_type(F.col("Improve")).alias("Improve_Type"),
                    improvement_label(F.col("Improve")).alias("Improve_Label"),
                    legend_symbol(improvement_label(F.col("Improve"))).alias("Legend")))

