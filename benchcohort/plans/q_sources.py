"""Source/sink queries (nested JSON stats, path metadata, snapshots,
multi-file ingest, code extraction, TSV round trip) and the score rows of
the badge and rescaled benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.binomial import exact_binomial_ci
from ..functions.rules import MODEL_CLEAN_RULES, replace_rules_sql
from ..operators import benchrows, stats
from ..operators.rubric import cleaned
from ..operators.scorecard import clean_model, with_model_names
from ..session import scratch_path, spread
from ..sources import files
from ..sources.tables import table
from .inputs import CASES_SQL, RUBRIC_SQL
from .inputs import cases as cases_input
from .inputs import rubric as rubric_input
from .registry import query, r6
from .sqlparts import binomial_ci_ctes, canonical_sql, improvement_sql

_CLEAN_RUBRIC = replace_rules_sql("model", MODEL_CLEAN_RULES["rubric"])


# ------------------------------------------------------------ stat records (A16 shape)
def _stat_records(spark, sf):
    items = cleaned(rubric_input(spark, sf))
    pert = F.when(F.col("axis") == "a1", "robustness").when(F.col("axis") == "a2", "fairness")
    return stats.stat_records(items, ["run_id", "model"],
                              {"exact_match": F.col("criterion_met"), "num_points": F.col("points")}, pert)


_STAT_SQL = f"""WITH rubric_raw AS ({RUBRIC_SQL}),
rubric AS (SELECT * REPLACE ({_CLEAN_RUBRIC} AS model) FROM rubric_raw),
st AS (
  SELECT run_id, model, 'exact_match' AS metric,
         CASE axis WHEN 'a1' THEN 'robustness' WHEN 'a2' THEN 'fairness' END AS pert, criterion_met AS x FROM rubric
  UNION ALL
  SELECT run_id, model, 'num_points' AS metric,
         CASE axis WHEN 'a1' THEN 'robustness' WHEN 'a2' THEN 'fairness' END AS pert, points AS x FROM rubric
),
agg AS (
  SELECT run_id, model, metric, pert, COUNT(x) AS n,
         CAST(SUM(CAST(round(x * 100.0) AS DECIMAL(38,0))) AS DOUBLE) AS s1,
         CAST(SUM(CAST(round(x * 100.0) AS DECIMAL(38,0)) * CAST(round(x * 100.0) AS DECIMAL(38,0))) AS DOUBLE) AS s2,
         MIN(x) AS mn, MAX(x) AS mx
  FROM st GROUP BY run_id, model, metric, pert
),
rec AS (
  SELECT run_id, model, metric, pert, CAST(n AS BIGINT) AS "count", s1 / 100.0 AS "sum", s2 / 10000.0 AS sum_squared,
         mn AS "min", mx AS "max", s1 / n / 100.0 AS mean,
         greatest((s2 / n - (s1 / n) * (s1 / n)) / 10000.0, 0.0) AS variance
  FROM agg
)"""

_REC_COLS = ('"count", "sum", sum_squared, "min", "max", mean, variance, sqrt(variance) AS stddev')


@query("stat_summary", sql="""
WITH a AS (
  SELECT l_returnflag, l_linestatus, COUNT(l_extendedprice) AS n,
         CAST(SUM(CAST(round(l_extendedprice * 100.0) AS DECIMAL(38,0))) AS DOUBLE) AS s1,
         CAST(SUM(CAST(round(l_extendedprice * 100.0) AS DECIMAL(38,0)) * CAST(round(l_extendedprice * 100.0) AS DECIMAL(38,0))) AS DOUBLE) AS s2,
         MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx
  FROM lineitem GROUP BY l_returnflag, l_linestatus
)
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS "count", s1 / 100.0 AS "sum", s2 / 10000.0 AS sum_squared,
       mn AS "min", mx AS "max", s1 / n / 100.0 AS mean,
       greatest((s2 / n - (s1 / n) * (s1 / n)) / 10000.0, 0.0) AS variance,
       sqrt(greatest((s2 / n - (s1 / n) * (s1 / n)) / 10000.0, 0.0)) AS stddev
FROM a""")
def stat_summary(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    agg = li.groupBy("l_returnflag", "l_linestatus").agg(*stats.summary_record(F.col("l_extendedprice"), 2))
    return stats.finish_summary(agg, ["l_returnflag", "l_linestatus"], 2)


@query("stat_select", sql=_STAT_SQL + """
SELECT run_id, model,
       MAX(CASE WHEN regexp_matches(metric, 'exact_match|accuracy') AND pert = 'robustness' AND mean IS NOT NULL
                THEN mean END) AS val,
       CAST(SUM(CASE WHEN regexp_matches(metric, 'exact_match|accuracy') AND pert = 'robustness' THEN 1 ELSE 0 END) AS BIGINT) AS n_matched
FROM rec GROUP BY run_id, model""")
def stat_select(spark, sf):
    best = stats.best_stat(_stat_records(spark, sf), ["run_id", "model"])
    return best.select("run_id", "model", "val", F.col("n_matched").cast("bigint").alias("n_matched"))


@query("scan_nested_json", sql=_STAT_SQL + f"""
SELECT run_id AS bench, model, metric, 'test' AS split, pert,
       CASE WHEN pert IS NULL THEN NULL ELSE pert = 'robustness' END AS robustness, {_REC_COLS}
FROM rec""")
def scan_nested_json(spark, sf):
    root = scratch_path(spark, "stats-tree")
    files.write_stat_files(spark, _stat_records(spark, sf), root, "run_id", "model")
    df = files.read_stat_files(spark, root)
    d = files.run_dir(F.col("file_path"))
    return df.select(files.bench_from_dir(d).alias("bench"), files.model_from_dir(d).alias("model"),
                     F.col("name.name").alias("metric"), F.col("name.split").alias("split"),
                     F.col("name.perturbation.name").alias("pert"),
                     F.col("name.perturbation.robustness").alias("robustness"),
                     "count", "sum", "sum_squared", "min", "max", "mean", "variance", "stddev")


@query("path_metadata", sql="""
WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS parts FROM pages)
SELECT page_id, parts[3] AS host, parts[-2] AS dir, parts[-1] AS leaf,
       regexp_replace(parts[-2], ':.*$', '') AS bench,
       regexp_replace(regexp_replace(parts[-2], '^.*:', ''), '^.*_', '') AS model
FROM p""")
def path_metadata(spark, sf):
    pg = table(spark, sf, "pages").select("page_id", "url")
    parts = F.split(F.regexp_replace("url", "[?#].*$", ""), "/")
    d = F.element_at(parts, -2)
    return pg.select("page_id", F.element_at(parts, 3).alias("host"), d.alias("dir"),
                     F.element_at(parts, -1).alias("leaf"), files.bench_from_dir(d).alias("bench"),
                     files.model_from_dir(d).alias("model"))


# ------------------------------------------------------------ snapshots
_CUTOFFS = [("healthbench_20240110", "2024-01-11"), ("healthbench_20240120", "2024-01-21"),
            ("healthbench_20240131", "2024-02-01")]


@query("newest_snapshot", sql=f"""
SELECT '{_CUTOFFS[-1][0]}' AS snapshot, event_type, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents
FROM events WHERE ts < TIMESTAMP '{_CUTOFFS[-1][1]}' GROUP BY event_type""")
def newest_snapshot(spark, sf):
    folder = scratch_path(spark, "snapshots")
    ev = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    for name, cutoff in _CUTOFFS:
        ev.filter(F.col("ts") < F.lit(cutoff).cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/{name}")
    name, snap = files.newest_snapshot(spark, folder, "healthbench")
    return (snap.groupBy("event_type")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("value_cents"))
                .select(F.lit(name).alias("snapshot"), "event_type", "n", "value_cents"))


# ------------------------------------------------------------ multi-source ingest
MIN_BALANCE = 0.0  # keep accounts in credit (the extract's row filter)


@query("multi_source_union", sql=f"""
SELECT 'Customer' AS src, c_custkey AS "key", c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal,
       c_mktsegment AS mktsegment
FROM customer WHERE c_acctbal >= {MIN_BALANCE}
UNION ALL BY NAME
SELECT 'Supplier' AS src, s_suppkey AS "key", s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal
FROM supplier WHERE s_acctbal >= {MIN_BALANCE}""")
def multi_source_union(spark, sf):
    root = scratch_path(spark, "extracts")
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    supp = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"))
    specs = [("data_processed_customer", cust, "key BIGINT, name STRING, nationkey INT, acctbal DOUBLE, mktsegment STRING"),
             ("data_processed_supplier", supp, "key BIGINT, name STRING, nationkey INT, acctbal DOUBLE")]
    frames = []
    for name, df, schema in specs:
        path = f"{root}/{name}"
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
        back = (files.read_delimited(spark, path, schema, sep=",", rebalance=True)
                .withColumn("src", files.source_label(F.col("source_file"))).drop("source_file"))
        frames.append(back.filter(F.col("acctbal") >= MIN_BALANCE))
    out = files.union_sources(frames)
    return out.select("src", "key", "name", "nationkey", "acctbal", "mktsegment")


# ------------------------------------------------------------ code extraction
@query("extract_codes", sql="""
WITH frags AS (SELECT page_id, unnest(string_split(html, '<')) AS frag FROM pages),
kept AS (SELECT page_id, replace(frag, '"', '''') AS line FROM frags WHERE regexp_matches(frag, '^a href='))
, codes AS (SELECT DISTINCT page_id, unnest(list_distinct(regexp_extract_all(line, '''\\s*(.*?)\\s*''', 1))) AS code FROM kept)
SELECT code, CAST(COUNT(DISTINCT page_id) AS BIGINT) AS n_pages FROM codes GROUP BY code""")
def extract_codes(spark, sf):
    pg = table(spark, sf, "pages").select("page_id", "html")
    frags = pg.select("page_id", F.explode(F.split("html", "<")).alias("frag"))
    kept = frags.filter(F.col("frag").rlike("^a href=")).select(
        "page_id", F.replace(F.col("frag"), F.lit('"'), F.lit("'")).alias("line"))
    codes = kept.select("page_id", F.explode(files.quoted_values(F.col("line"))).alias("code")).distinct()
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n_pages"))


_LINES_SQL = """SELECT CASE p_partkey % 4
  WHEN 0 THEN 'var brand' || p_partkey || ' = RX( "' || p_size || '" , ''' || p_partkey || ''',"' || p_size || '")'
  WHEN 1 THEN 'var  b' || p_partkey || '=rx (''' || p_size || ''')'
  WHEN 2 THEN '// var c' || p_partkey || ' = rx(''' || p_size || ''')'
  ELSE 'var d' || p_partkey || ' = dx(''' || p_size || ''')' END AS line FROM part"""


@query("code_lists", sql=f"""
WITH lines AS ({_LINES_SQL}),
kept AS (SELECT replace(regexp_replace(line, '^var ', ''), '"', '''') AS body FROM lines
         WHERE regexp_matches(line, '^var') AND regexp_matches(replace(lower(line), ' ', ''), 'rx\\(|rx='))
SELECT trim(split_part(body, '=', 1)) AS name, unnest(list_distinct(regexp_extract_all(body, '''\\s*(.*?)\\s*''', 1))) AS code FROM kept""")
def code_lists(spark, sf):
    """Definitions that list codes, from a text of one definition a line."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.col("p_partkey") % 4
    line = (F.when(kind == 0, text("var brand", key, ' = RX( "', size, "\" , '", key, "',\"", size, '")'))
            .when(kind == 1, text("var  b", key, "=rx ('", size, "')")).when(kind == 2, text("// var c", key, " = rx('", size, "')"))
            .otherwise(text("var d", key, " = dx('", size, "')")))
    path = scratch_path(spark, "definitions")
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return files.code_lists(spark.read.text(path))


@query("enrich_codes", sql="""
WITH codes AS (
  SELECT DISTINCT CAST(regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) AS BIGINT) AS code FROM pages
  WHERE regexp_matches(url, '/([0-9]+)(?:[/.?#]|$)')
)
SELECT c.code, p.p_brand AS brand_name, p.p_name AS rx_name FROM codes c LEFT JOIN part p ON c.code = p.p_partkey""")
def enrich_codes(spark, sf):
    pat = r"/([0-9]+)(?:[/.?#]|$)"
    urls = table(spark, sf, "pages").select("url").filter(F.col("url").rlike(pat))
    codes = urls.select(F.regexp_extract("url", pat, 1).cast("bigint").alias("code")).distinct()
    dim = table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand_name"),
                                          F.col("p_name").alias("rx_name"))
    # The dimension grows with the data: let AQE choose broadcast vs shuffle from measured sizes.
    return codes.join(dim, "code", "left")


# ------------------------------------------------------------ TSV sink (K1, K2)
@query("tsv_roundtrip", sql="""
SELECT c_name AS "Customer Name", c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       c_mktsegment, c_nationkey FROM customer""")
def tsv_roundtrip(spark, sf):
    path = scratch_path(spark, "tsv")
    cust = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.pmod("c_custkey", F.lit(11)) == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment", "c_nationkey")
    files.write_tsv(cust, path, first_column="c_name", label="Customer Name")
    schema = "`Customer Name` STRING, c_custkey BIGINT, c_acctbal DOUBLE, c_mktsegment STRING, c_nationkey INT"
    return files.read_delimited(spark, path, schema).drop("source_file")


# ------------------------------------------------------------ badge scores
def _badge_table(spark, sf):
    """Badge counts per provider (segment) from orders: orders are first
    collapsed to (customer, status) counts, so the join with customer moves
    one row per customer and status instead of one per order (Catalyst does
    not push aggregates below joins)."""
    from pyspark.sql import Window
    o = (table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus")
         .agg(F.count(F.lit(1)).alias("cnt")))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    badge = F.when(F.col("o_orderstatus") == "F", "Green").when(F.col("o_orderstatus") == "O", "Yellow").otherwise("Red")
    cnt = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
           .groupBy(F.concat(F.lower("c_mktsegment"), F.lit("_choose_best")).alias("provider"), badge.alias("badge"))
           .agg(F.sum("cnt").alias("total_count")))
    tot = F.sum("total_count").over(Window.partitionBy("provider"))
    return cnt.withColumn("provider_total", tot).withColumn("pct_of_provider", F.col("total_count") * 100.0 / tot)


def _badge_scores_rows(spark, sf):
    """Answered-with-evidence style score rows: Green share, and 1 - Red share
    (reverse scored), with exact intervals on the provider total."""
    return benchrows.badge_score_rows(_badge_table(spark, sf).select(
        "provider", "badge", "total_count", "pct_of_provider"))


def _badge_scores(spark, sf):
    rows = _badge_scores_rows(spark, sf)
    return with_model_names(rows).select("Bench", "Model", "n", F.col("_x").alias("x"), "Center", "L95", "U95")


_BADGE_SQL_CTES = f"""WITH RECURSIVE cnt AS (
  SELECT lower(c_mktsegment) || '_choose_best' AS provider,
         CASE o_orderstatus WHEN 'F' THEN 'Green' WHEN 'O' THEN 'Yellow' ELSE 'Red' END AS badge,
         COUNT(*) AS total_count
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
),
tbl AS (SELECT *, SUM(total_count) OVER (PARTITION BY provider) AS provider_total,
               total_count * 100.0 / SUM(total_count) OVER (PARTITION BY provider) AS pct_of_provider FROM cnt),
b1 AS (
  SELECT replace(provider, '_choose_best', '-alexandria_p') AS Model_Orig, badge,
         CASE WHEN badge = 'Red' THEN 1 - pct_of_provider / 100.0 ELSE pct_of_provider / 100.0 END AS Center,
         CAST(provider_total AS BIGINT) AS n
  FROM tbl WHERE badge IN ('Green', 'Red')
),
b2 AS (
  SELECT 'Answered with Evidence: ' || CASE WHEN badge = 'Green' THEN '01.Green' ELSE '02.Red (reverse scored)' END AS Bench,
         Model_Orig, n, Center, CAST(round_even(Center * n, 0) AS BIGINT) AS x
  FROM b1
),
{binomial_ci_ctes('b2', ['Bench', 'Model_Orig'], name='bci')},
badge_rows AS (
  SELECT b.Bench, trim({canonical_sql('b.Model_Orig')} || {improvement_sql('b.Model_Orig')}) AS Model, b.n, b.x,
         b.Center, c.lcl AS L95, c.ucl AS U95
  FROM b2 b JOIN bci c ON b.Bench = c.Bench AND b.Model_Orig = c.Model_Orig
)"""


@query("badge_summary", sql=_BADGE_SQL_CTES + """
SELECT Bench, Model, n, x, round(Center, 6) AS Center, round(L95, 6) AS L95, round(U95, 6) AS U95 FROM badge_rows""")
def badge_summary(spark, sf):
    return _badge_scores(spark, sf).select("Bench", "Model", "n", "x", r6("Center"), r6("L95"), r6("U95"))


# ------------------------------------------------------------ rescaled limits
_MEDHELM = {"A": "medhallu", "N": "medi_qa", "R": "pubmed_qa"}
_BINOMIAL_BENCHES = ("medhallu", "pubmed_qa")
_MEDHELM_N = 1000  # the reference's fixed n (D2)


def _rescaled(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    bench = (F.when(F.col("l_returnflag") == "A", "medhallu").when(F.col("l_returnflag") == "N", "medi_qa")
              .otherwise("pubmed_qa"))
    model = F.when(F.col("l_linestatus") == "O", "databricks-llama-4-maverick-rag").otherwise("llama-3.3-70b-versatile")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    agg = (li.groupBy(bench.alias("b"), model.alias("Model_Orig"))
             .agg((F.sum(cents) / F.count(F.lit(1)) / F.lit(10.0)).alias("score01")))
    agg = spread(agg.withColumn("Model_Orig", clean_model(F.col("Model_Orig"), "med_helm")))
    is_bin = F.col("b").isin(*_BINOMIAL_BENCHES)
    val = F.when(is_bin, F.col("score01")).otherwise(F.col("score01") * 5.0)
    center = F.when(is_bin, val).otherwise(val / 5.0)
    x = F.bround(center * _MEDHELM_N, 0).cast("bigint")
    ci = exact_binomial_ci(x, F.lit(_MEDHELM_N))
    out = agg.select(
        F.concat(F.lit("MedHELM: "), F.col("b"), F.when(is_bin, F.lit("")).otherwise(F.lit(" (rescale, max=5)"))).alias("Bench"),
        "Model_Orig", F.lit(_MEDHELM_N).cast("bigint").alias("n"), center.alias("Center"),
        F.when(is_bin, ci["lcl"]).otherwise(center - 0.025).alias("L95"),
        F.when(is_bin, ci["ucl"]).otherwise(center + 0.025).alias("U95"),
        F.when(is_bin, 0).otherwise(1).alias("limits_not_ci"))
    return with_model_names(out)


_RESCALED_SQL_CTES = f"""WITH RECURSIVE agg AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'medhallu' WHEN 'N' THEN 'medi_qa' ELSE 'pubmed_qa' END AS b,
         regexp_replace(regexp_replace(CASE WHEN l_linestatus = 'O' THEN 'databricks-llama-4-maverick-rag'
              ELSE 'llama-3.3-70b-versatile' END, 'databricks-', '', 'g'), '-rag', '-multi', 'g') AS Model_Orig,
         CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / COUNT(*) / 10.0 AS score01
  FROM lineitem GROUP BY 1, 2
),
v AS (
  SELECT b, Model_Orig, b IN ('medhallu', 'pubmed_qa') AS is_bin,
         CASE WHEN b IN ('medhallu', 'pubmed_qa') THEN score01 ELSE score01 * 5.0 END AS val
  FROM agg
),
w AS (SELECT *, CASE WHEN is_bin THEN val ELSE val / 5.0 END AS Center, CAST({_MEDHELM_N} AS BIGINT) AS n FROM v),
w2 AS (SELECT *, CAST(round_even(Center * {_MEDHELM_N}, 0) AS BIGINT) AS x FROM w),
{binomial_ci_ctes('w2', ['b', 'Model_Orig'], name='rci')},
rescaled_rows AS (
  SELECT 'MedHELM: ' || w2.b || CASE WHEN is_bin THEN '' ELSE ' (rescale, max=5)' END AS Bench,
         trim({canonical_sql('w2.Model_Orig')} || {improvement_sql('w2.Model_Orig')}) AS Model,
         w2.n, w2.Center,
         CASE WHEN is_bin THEN c.lcl ELSE w2.Center - 0.025 END AS L95,
         CASE WHEN is_bin THEN c.ucl ELSE w2.Center + 0.025 END AS U95,
         CASE WHEN is_bin THEN 0 ELSE 1 END AS limits_not_ci
  FROM w2 JOIN rci c ON w2.b = c.b AND w2.Model_Orig = c.Model_Orig
)"""


@query("rescaled_limits", sql=_RESCALED_SQL_CTES + """
SELECT Bench, Model, n, round(Center, 6) AS Center, round(L95, 6) AS L95, round(U95, 6) AS U95, limits_not_ci
FROM rescaled_rows""")
def rescaled_limits(spark, sf):
    return _rescaled(spark, sf).select("Bench", "Model", "n", r6("Center"), r6("L95"), r6("U95"), "limits_not_ci")


# ------------------------------------------------------------ score union
@query("score_union", sql=_RESCALED_SQL_CTES + ",\n"
       + _BADGE_SQL_CTES.replace("WITH RECURSIVE ", "") + f""",
case_rows AS (
  SELECT 'Cases: ' || bench AS Bench,
         trim({canonical_sql("replace(raw_model, 'meta-llama/', '')")} || {improvement_sql("replace(raw_model, 'meta-llama/', '')")}) AS Model,
         CAST(COUNT(score) AS BIGINT) AS n, SUM(score) / COUNT(score) AS Center, 0 AS limits_not_ci
  FROM ({CASES_SQL}) GROUP BY 1, 2
)
SELECT Bench, Model, n, round(Center, 6) AS Center, CAST(NULL AS DOUBLE) AS L95, CAST(NULL AS DOUBLE) AS U95, limits_not_ci FROM case_rows
UNION ALL BY NAME
SELECT Bench, Model, n, round(Center, 6) AS Center, round(L95, 6) AS L95, round(U95, 6) AS U95, limits_not_ci FROM rescaled_rows
UNION ALL BY NAME
SELECT Bench, Model, n, round(Center, 6) AS Center, round(L95, 6) AS L95, round(U95, 6) AS U95 FROM badge_rows""")
def score_union(spark, sf):
    cs = cases_input(spark, sf).withColumn("Model_Orig", clean_model(F.col("raw_model"), "cases"))
    cs = (with_model_names(cs).groupBy(F.concat(F.lit("Cases: "), F.col("bench")).alias("Bench"), "Model")
          .agg(F.count("score").alias("n"), (F.sum("score") / F.count("score")).alias("Center"))
          .select("Bench", "Model", "n", r6("Center"), F.lit(None).cast("double").alias("L95"),
                  F.lit(None).cast("double").alias("U95"), F.lit(0).alias("limits_not_ci")))
    rs = _rescaled(spark, sf).select("Bench", "Model", "n", r6("Center"), r6("L95"), r6("U95"), "limits_not_ci")
    bd = _badge_scores(spark, sf).select("Bench", "Model", "n", r6("Center"), r6("L95"), r6("U95"))
    return cs.unionByName(rs, allowMissingColumns=True).unionByName(bd, allowMissingColumns=True)

