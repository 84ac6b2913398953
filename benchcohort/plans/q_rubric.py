"""Rubric and bootstrap queries (V_rubric, V_cases, lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import h_sql, poisson1_of_sql, stream_sql
from ..functions.rules import MODEL_CLEAN_RULES, replace_rules_sql
from ..functions.sampling import binomial_draw_ctes, poisson_draw_ctes
from ..operators import intervals, rubric
from ..operators.scorecard import clean_model, with_model_names
from ..session import spread, under_parallel
from ..sources.tables import table
from .inputs import CASES_SQL, RUBRIC_SQL, cases
from .inputs import rubric as rubric_input
from .registry import query, r6
from .sqlparts import canonical_sql, improvement_sql

# The reference's seed and number of replicates.
SEED = 46664
R_CASES = 1000
R_RUBRIC = 1000
R_POISSON = 1000

_CLEAN = replace_rules_sql("model", MODEL_CLEAN_RULES["rubric"])
RUBRIC_CTES = f"""WITH rubric_raw AS ({RUBRIC_SQL}),
rubric AS (SELECT * REPLACE ({_CLEAN} AS model) FROM rubric_raw),
latest AS (SELECT * FROM rubric r WHERE run_id = (SELECT MAX(run_id) FROM rubric r2 WHERE r2.model = r.model))"""

_SCORE_SQL = """CASE WHEN COUNT(points * criterion_met) = COUNT(*) THEN
       CASE WHEN SUM(CASE WHEN points > 0 THEN points ELSE 0.0 END) = 0 THEN NULL
            ELSE SUM(points * criterion_met) / SUM(CASE WHEN points > 0 THEN points ELSE 0.0 END) END
     END"""

GROUPING_SQL = RUBRIC_CTES + f""",
gs AS (
  SELECT model, run_id, conversation_id, axis, theme, GROUPING(axis) AS ga, GROUPING(theme) AS gt,
         {_SCORE_SQL} AS score
  FROM latest
  GROUP BY GROUPING SETS ((model, run_id, conversation_id), (model, run_id, conversation_id, axis),
                          (model, run_id, conversation_id, theme))
),
scores AS (
  SELECT model, run_id,
         CASE WHEN ga = 0 THEN 'axis:' || coalesce(axis, 'NA') WHEN gt = 0 THEN 'theme:' || coalesce(theme, 'NA')
              ELSE '.Overall' END AS grp,
         conversation_id, score
  FROM gs
)"""


def _items(spark, sf):
    return rubric.cleaned(rubric_input(spark, sf))


def latest_grouped(spark, sf):
    """Grouping-set scores of each model's latest run."""
    return rubric.latest_scores(rubric.grouping_set_scores(_items(spark, sf)))


@query("latest_run", sql=RUBRIC_CTES + """
SELECT model, run_id, conversation_id, rubric_criterion_index, points, criterion_met FROM latest""")
def latest_run(spark, sf):
    return rubric.latest_run(_items(spark, sf)).select("model", "run_id", "conversation_id", "rubric_criterion_index",
                                                       "points", "criterion_met")


@query("rubric_score", sql=RUBRIC_CTES + f"""
SELECT model, run_id, conversation_id, {_SCORE_SQL} AS score
FROM latest GROUP BY model, run_id, conversation_id""")
def rubric_score(spark, sf):
    return rubric.latest_scores(rubric.conversation_scores(_items(spark, sf)))


@query("rubric_grouping_sets", sql=GROUPING_SQL + """
SELECT model, run_id, grp, conversation_id, score FROM scores""")
def rubric_grouping_sets(spark, sf):
    return latest_grouped(spark, sf)


def _title_sql(x: str) -> str:
    spaced = f"replace(replace({x}, '_', ' '), ':', ': ')"
    words = (f"array_to_string(list_transform(string_split(lower({spaced}), ' '), "
             f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
    return f"replace('HealthBench: ' || {words}, '.overall', '.Overall')"


@query("title_label", sql=GROUPING_SQL + f"""
SELECT grp, {_title_sql('grp')} AS Bench FROM (SELECT DISTINCT grp FROM scores)""")
def title_label(spark, sf):
    grps = latest_grouped(spark, sf).select("grp").distinct()
    return grps.select("grp", rubric.bench_title(F.col("grp")).alias("Bench"))


# ----------------------------------------------------------------- bootstraps
SQL_LEVELS = 6  # binary digits of leaf numbers that the SQL spells out: 64 leaves a group


def _multinomial_sql(units: str, keys: list[str], value: str, R: int, seed: int, drop_null: bool, prefix: str = "bs") -> str:
    """Multinomial resampling of cells: counts of leaves by halves, then units within leaves of several values."""
    k = ", ".join(keys)
    p, leaf = prefix, intervals.LEAF
    where = f"WHERE {value} IS NOT NULL" if drop_null else ""
    ctes = [f"""{p}_cells AS MATERIALIZED (SELECT {k}, CAST({value} AS DOUBLE) AS v, COUNT(*) AS c FROM {units} {where} GROUP BY ALL),
{p}_num AS (
  SELECT *, SUM(c) OVER (PARTITION BY {k} ORDER BY v NULLS FIRST) - c AS earlier,
         CASE WHEN v IS NULL THEN 2 WHEN c >= {leaf} THEN 1 ELSE 0 END AS alone FROM {p}_cells),
{p}_placed AS MATERIALIZED (SELECT *, CASE WHEN alone = 2 THEN -1 ELSE CAST(earlier AS BIGINT) // {leaf} * 2 + alone END AS place FROM {p}_num),
{p}_leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY place) - 1 AS i
  FROM (SELECT {k}, place, CAST(SUM(c) AS BIGINT) AS w, COUNT(*) AS m, MIN(v) AS v, MIN(earlier) AS start FROM {p}_placed GROUP BY {k}, place)),
{p}_sizes AS MATERIALIZED (
  SELECT {k}, CAST(SUM(c) AS BIGINT) AS n_all, COALESCE(SUM(CASE WHEN v IS NOT NULL THEN c END), 0) AS n_nonnull,
         SUM(v * c) / SUM(CASE WHEN v IS NOT NULL THEN c END) AS mean_v FROM {p}_cells GROUP BY {k}),
{p}_k0 AS MATERIALIZED (SELECT {k}, r, {h_sql(str(seed), 'r')} AS base, 0 AS node, CAST(n_all AS DOUBLE) AS k FROM {p}_sizes, range(0, {R}) t(r))"""]
    for level in range(SQL_LEVELS):
        half = 1 << level
        ctes.append(f"""{p}_w{level} AS (
  SELECT {k}, i % {half} AS node, SUM(w) AS total, SUM(CASE WHEN i % {2 * half} = i % {half} THEN w ELSE 0 END) AS below
  FROM {p}_leaves GROUP BY {k}, i % {half}),
{p}_src{level} AS MATERIALIZED (
  SELECT {k}, r, node, k AS n, below / total AS p, {stream_sql('base', f'node + {half}')} AS base
  FROM {p}_k{level} JOIN {p}_w{level} USING ({k}, node)),
{binomial_draw_ctes(f'{p}_src{level}', f'{k}, r, node', f'{p}_d{level}')},
{p}_k{level + 1} AS MATERIALIZED (
  SELECT * FROM (SELECT {k}, r, base, node, x.k FROM {p}_k{level} JOIN {p}_d{level} x USING ({k}, r, node)
                 UNION ALL SELECT {k}, r, base, node + {half}, o.k - x.k FROM {p}_k{level} o JOIN {p}_d{level} x USING ({k}, r, node)) WHERE k > 0)""")
    ctes.append(f"""{p}_leaf_k AS MATERIALIZED (
  SELECT {k}, r, base, node AS i, k, place, w, m, v, start FROM {p}_k{SQL_LEVELS} JOIN (SELECT *, i AS node FROM {p}_leaves) USING ({k}, node)),
{p}_units AS (
  SELECT {k}, place, v, unnest(range(CAST(earlier AS BIGINT), CAST(earlier + c AS BIGINT))) AS pos FROM {p}_placed WHERE alone = 0),
{p}_draws AS (
  SELECT {k}, r, place, start, w, {stream_sql(stream_sql('base', '0'), 'i')} AS own, unnest(range(1, CAST(k AS BIGINT) + 1)) AS j FROM {p}_leaf_k WHERE m > 1),
{p}_at AS (SELECT {k}, r, place, CAST(start AS BIGINT) + {stream_sql('own', 'j')} % w AS pos FROM {p}_draws),
{p}_parts AS (
  SELECT {k}, r, v * k AS s, CASE WHEN v IS NOT NULL THEN k ELSE 0 END AS n FROM {p}_leaf_k WHERE m = 1
  UNION ALL SELECT {k}, r, SUM(v), COUNT(*) FROM {p}_at JOIN {p}_units USING ({k}, place, pos) GROUP BY {k}, r),
{p}_means AS (SELECT {k}, r, SUM(s) / NULLIF(SUM(n), 0) AS rep_mean FROM {p}_parts GROUP BY {k}, r),
{p}_q AS (
  SELECT {k}, quantile_cont(rep_mean, 0.5) AS q50, quantile_cont(rep_mean, 0.025) AS q025,
         quantile_cont(rep_mean, 0.975) AS q975
  FROM {p}_means GROUP BY {k}
)""")
    return ",\n".join(ctes)


def _poisson_cells_sql(units: str, keys: list[str], value: str, R: int, seed: int, prefix: str = "pw") -> str:
    """Replicate means by one Poisson weight a cell, and their limits."""
    k, p = ", ".join(keys), prefix
    key = h_sql(str(seed), *[f"COALESCE(CAST({x} AS VARCHAR), 'NA')" for x in keys], "CAST(v AS DECIMAL(38,6))")
    return f"""{p}_cells AS MATERIALIZED (
  SELECT {k}, CAST({value} AS DOUBLE) AS v, COUNT(*) AS c FROM {units} WHERE {value} IS NOT NULL GROUP BY ALL),
{p}_src AS MATERIALIZED (
  SELECT {k}, v, c AS n, r, {stream_sql('cell', 'r')} AS base FROM (SELECT *, {key} AS cell FROM {p}_cells), range(0, {R}) t(r)),
{poisson_draw_ctes(f'{p}_src', f'{k}, v, r', f'{p}_d')},
{p}_means AS (SELECT {k}, r, SUM(k * v) / NULLIF(SUM(k), 0) AS rep_mean FROM {p}_d GROUP BY {k}, r),
{p}_q AS (
  SELECT {k}, quantile_cont(rep_mean, 0.5) AS q50, quantile_cont(rep_mean, 0.025) AS q025,
         quantile_cont(rep_mean, 0.975) AS q975, COUNT(rep_mean) AS r_used FROM {p}_means GROUP BY {k}),
{p}_point AS (SELECT {k}, SUM(v * c) / SUM(c) AS mean_v, CAST(SUM(c) AS BIGINT) AS n FROM {p}_cells GROUP BY {k})"""


_CASE_ACC_SQL = f"""WITH cases AS ({CASES_SQL}),
named AS (SELECT *, trim({canonical_sql("replace(raw_model, 'meta-llama/', '')")} ||
                         {improvement_sql("replace(raw_model, 'meta-llama/', '')")}) AS Model FROM cases),
case_acc AS (SELECT Model, case_id, AVG(CASE WHEN score IS NULL THEN 0 ELSE score END) AS correct FROM named GROUP BY Model, case_id)"""


def _case_accuracy(spark, sf):
    c = cases(spark, sf).withColumn("Model_Orig", clean_model(F.col("raw_model"), "cases"))
    c = with_model_names(c)
    return rubric.case_accuracy(c, "Model")


@query("case_accuracy", sql=_CASE_ACC_SQL + """
SELECT Model, CAST(COUNT(*) AS BIGINT) AS n_cases, SUM(correct) / COUNT(*) AS accuracy FROM case_acc GROUP BY Model""")
def case_accuracy(spark, sf):
    acc = _case_accuracy(spark, sf)
    return acc.groupBy("Model").agg(F.count(F.lit(1)).alias("n_cases"),
                                    (F.sum("correct") / F.count(F.lit(1))).alias("accuracy"))


@query("bootstrap_multinomial", sql=_CASE_ACC_SQL + ",\n" + _multinomial_sql(
    "case_acc", ["Model"], "correct", R_CASES, SEED, drop_null=False) + """
SELECT 'CPC' AS Bench, s.Model, CAST(s.n_nonnull AS BIGINT) AS n, round(q.q50, 6) AS Center,
       round(q.q025, 6) AS L95, round(q.q975, 6) AS U95
FROM bs_sizes s JOIN bs_q q ON s.Model = q.Model""")
def bootstrap_multinomial(spark, sf):
    acc = _case_accuracy(spark, sf)
    out = intervals.bootstrap_distribution(acc, ["Model"], "case_id", "correct", R_CASES, SEED)
    return out.select(F.lit("CPC").alias("Bench"), "Model", "n", r6("Center"), r6("L95"), r6("U95"))


@query("bootstrap_mean_ci", sql=GROUPING_SQL + ",\n" + _multinomial_sql(
    "scores", ["model", "run_id", "grp"], "score", R_RUBRIC, SEED, drop_null=True) + f"""
SELECT s.model, s.run_id, s.grp, round(s.mean_v, 6) AS mean, round(q.q025, 6) AS lcl, round(q.q975, 6) AS ucl,
       CAST(s.n_nonnull AS BIGINT) AS n, {R_RUBRIC} AS R, {SEED} AS seed
FROM bs_sizes s JOIN bs_q q ON s.model = q.model AND s.run_id = q.run_id AND s.grp = q.grp""")
def bootstrap_mean_ci(spark, sf):
    scores = latest_grouped(spark, sf)
    out = intervals.bootstrap_mean_ci(scores, ["model", "run_id", "grp"], "conversation_id", "score",
                                      R_RUBRIC, SEED)
    return out.select("model", "run_id", "grp", r6("mean"), r6("lcl"), r6("ucl"), "n",
                      F.col("R").cast("int").alias("R"), F.col("seed").cast("int").alias("seed"))


@query("bootstrap_mean_ci_poisson", sql=GROUPING_SQL + ",\n" + _poisson_cells_sql(
    "scores", ["model", "run_id", "grp"], "score", R_RUBRIC, SEED) + """
SELECT p.model, p.run_id, p.grp, round(p.mean_v, 6) AS mean, round(q.q025, 6) AS lcl, round(q.q975, 6) AS ucl,
       CAST(p.n AS BIGINT) AS n
FROM pw_point p JOIN pw_q q ON p.model = q.model AND p.run_id = q.run_id AND p.grp = q.grp""")
def bootstrap_mean_ci_poisson(spark, sf):
    scores = latest_grouped(spark, sf)
    out = intervals.bootstrap_mean_ci(scores, ["model", "run_id", "grp"], "conversation_id", "score",
                                      R_RUBRIC, SEED, method="poisson")
    return out.select("model", "run_id", "grp", r6("mean"), r6("lcl"), r6("ucl"), "n")


def _poisson_sql(R: int, seed: int, width: int = 8) -> str:
    blocks = (R + width - 1) // width
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(round(l_extendedprice * 100) AS BIGINT)")
    ws = [f"CAST({poisson1_of_sql(stream_sql('h0', f'b * {width} + {j}'))} AS BIGINT) AS w{j}" for j in range(width)]
    return f"""WITH li AS (
  SELECT l_returnflag, CAST(round(l_discount * 100) AS BIGINT) AS x, {h_sql(str(seed), *key)} AS h0
  FROM lineitem WHERE l_discount IS NOT NULL
),
blk AS (SELECT l_returnflag, x, h0, b FROM li, range(0, {blocks}) t(b)),
wts AS (SELECT l_returnflag, x, b, {", ".join(ws)} FROM blk),
per_block AS (
  SELECT l_returnflag, b, {", ".join(f"SUM(w{j} * x) AS wx{j}, SUM(w{j}) AS sw{j}" for j in range(width))}
  FROM wts GROUP BY l_returnflag, b
),
reps AS (
  {" UNION ALL ".join(f"SELECT l_returnflag, b * {width} + {j} AS r, wx{j} AS wx, sw{j} AS sw FROM per_block" for j in range(width))}
),
means AS (SELECT l_returnflag, r, CASE WHEN sw = 0 THEN NULL ELSE wx / sw END / 100.0 AS rep_mean FROM reps WHERE r < {R}),
point AS (SELECT l_returnflag, CAST(COUNT(*) AS BIGINT) AS n,
                 CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / COUNT(*) / 100.0 AS mean
          FROM lineitem WHERE l_discount IS NOT NULL GROUP BY l_returnflag)
SELECT p.l_returnflag, p.n, p.mean, round(quantile_cont(m.rep_mean, 0.025), 6) AS L95,
       round(quantile_cont(m.rep_mean, 0.5), 6) AS Median, round(quantile_cont(m.rep_mean, 0.975), 6) AS U95,
       CAST(COUNT(m.rep_mean) AS BIGINT) AS R_used
FROM point p JOIN means m ON p.l_returnflag = m.l_returnflag
GROUP BY p.l_returnflag, p.n, p.mean"""


@query("bootstrap_poisson", sql=_poisson_sql(R_POISSON, SEED))
def bootstrap_poisson(spark, sf):
    """Every line item draws its own weight in each replicate; those without a discount have no part."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_extendedprice", "l_discount", "l_returnflag").filter("l_discount IS NOT NULL")
    li = spread(li) if under_parallel(li) else li
    key = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
           F.round(F.col("l_extendedprice") * 100).cast("bigint")]
    out = intervals.poisson_units_summary(li, ["l_returnflag"], key, F.round(F.col("l_discount") * 100).cast("bigint"),
                                          R_POISSON, SEED, scale=100)
    return out.select("l_returnflag", "n", "mean", r6("L95"), r6("Median"), r6("U95"), "R_used")
