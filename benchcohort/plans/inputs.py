"""The three shared inputs of the query catalogue, built from the driver's tables.

* ``cases``  (V_cases)  — one judged case per labelled document.
* ``rubric`` (V_rubric) — one rubric criterion per event.
* ``cohort`` (V_cohort) — one patient-style row per order, with the
  raw-style column names of a cohort extract (cleaned by ``cohort_clean``).

Each input exists twice: as a Spark DataFrame (what the engine runs) and as
a DuckDB SQL CTE body (the independent oracle). Nulls are injected by
formula because the driver's tables carry none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# The model families and improvement suffixes assigned to cases.
CASE_MODELS = ["llama_mav4", "llama3_3", "openai_o3"]
CASE_SUFFIXES = ["", "-prompt", "-prompt2", "-multi"]
# Rubric model suffixes in their raw (pre-clean-up) spelling.
RUBRIC_SUFFIXES = ["", "-enhanced-prompt", "-prompt-completeness-3", "-prompt-context-awareness"]
# Ethnicity spellings of the raw extract (index = c_custkey % 4; last is missing).
ETHNICITIES = ["HISPANIC OR LATINO", "NOT HISPANIC OR LATINO", "DECLINED TO ANSWER", None]
# Outcome horizons: name suffix of the raw extract and days after the index date.
HORIZONS = [("3mo", 90), ("6mo", 180), ("12mo", 365)]


def _pick(values, idx):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx + F.lit(1)).cast("int"))


def _pick_sql(values, idx: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[({idx}) + 1]"


# --------------------------------------------------------------------- cases
def cases(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    j = labels.join(docs, "doc_id")
    return j.select(
        F.col("lang").alias("bench"),
        F.col("doc_id").alias("case_id"),
        F.col("quality").cast("int").alias("score"),
        F.concat(_pick(CASE_MODELS, F.pmod("doc_id", F.lit(3))),
                 _pick(CASE_SUFFIXES, F.pmod("doc_id", F.lit(4)))).alias("raw_model"),
    )


CASES_SQL = f"""
SELECT d.lang AS bench, l.doc_id AS case_id, CAST(l.quality AS INTEGER) AS score,
       {_pick_sql(CASE_MODELS, 'l.doc_id % 3')} || {_pick_sql(CASE_SUFFIXES, 'l.doc_id % 4')} AS raw_model
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


# -------------------------------------------------------------------- rubric
def rubric(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.select(
        F.concat(F.col("event_type"), _pick(RUBRIC_SUFFIXES, F.pmod("user_id", F.lit(4)))).alias("model"),
        F.concat(F.lit("r"), F.pmod(F.dayofmonth("ts"), F.lit(3)).cast("string")).alias("run_id"),
        F.col("user_id").alias("conversation_id"),
        F.col("event_id").alias("rubric_criterion_index"),
        (F.get_json_object("props", "$.k").cast("int") - F.lit(30)).cast("double").alias("points"),
        F.when(F.pmod("event_id", F.lit(211)) == 0, F.lit(None).cast("double"))
         .otherwise((F.col("value") > 100).cast("double")).alias("criterion_met"),
        F.concat(F.lit("a"), F.pmod("event_id", F.lit(3)).cast("string")).alias("axis"),
        F.concat(F.lit("t"), F.pmod("event_id", F.lit(5)).cast("string")).alias("theme"),
    )


RUBRIC_SQL = f"""
SELECT event_type || {_pick_sql(RUBRIC_SUFFIXES, 'user_id % 4')} AS model,
       'r' || CAST(dayofmonth(ts) % 3 AS VARCHAR) AS run_id,
       user_id AS conversation_id,
       event_id AS rubric_criterion_index,
       CAST(CAST(json_extract(props, '$.k') AS INTEGER) - 30 AS DOUBLE) AS points,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE CAST(value > 100 AS DOUBLE) END AS criterion_met,
       'a' || CAST(event_id % 3 AS VARCHAR) AS axis,
       't' || CAST(event_id % 5 AS VARCHAR) AS theme
FROM events
"""


# -------------------------------------------------------------------- cohort
def cohort_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Patient-style extract with raw column names (one row per order).

    Plan: lineitem ⋈ orders on the order key (both sides hash-partitioned on
    it) and the per-order aggregate reuses that partitioning; customer joins
    by key; nation and region are fixed-size dimensions and are broadcast.
    """
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                          "o_orderdate", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag",
                                             "l_linestatus", "l_shipdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")

    lag = F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))
    has_line = F.col("l_orderkey").isNotNull()
    aggs = [F.count("l_orderkey").alias("n_lines"),
            F.sum("l_quantity").alias("qty"),
            F.max("l_shipdate").alias("last_ship")]
    for suffix, days in HORIZONS:
        within = (lag >= 0) & (lag <= days)
        aggs.append(F.max(F.when(~has_line, None).when((F.col("l_returnflag") == "R") & within, 1)
                          .otherwise(0)).alias(f"ip_{suffix}"))
        aggs.append(F.max(F.when(~has_line, None).when((F.col("l_linestatus") == "O") & within, 1)
                          .otherwise(0)).alias(f"rc_{suffix}"))
    per_order = (o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
                 .groupBy("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
                 .agg(*aggs))
    geo = F.broadcast(n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
                      .select("n_nationkey", "r_name"))
    j = (per_order.join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey")))
    dob = F.date_add(F.lit("1940-01-01").cast("date"), F.pmod("c_custkey", F.lit(9000)).cast("int"))
    cols = [
        F.col("o_orderkey").alias("V1"),
        F.col("o_orderkey").alias("Patient_ID"),
        F.col("r_name").alias("src"),
        F.col("o_orderpriority").alias("Intervention"),
        F.year("o_orderdate").alias("Index_Year"),
        dob.alias("DOB"),
        F.datediff(F.col("o_orderdate").cast("date"), dob).alias("Index_Date"),
        F.col("c_custkey").alias("ZIP"),
        _pick(ETHNICITIES, F.pmod("c_custkey", F.lit(4))).alias("Ethnicity"),
        F.floor(F.datediff(F.col("o_orderdate").cast("date"), dob) / F.lit(365.25)).cast("int").alias("Age"),
        F.col("o_totalprice").alias("Baseline_Baseline_TotalPrice_cont"),
        F.col("c_acctbal").alias("Comorb_AcctBal_cont"),
        F.when(F.pmod("o_orderkey", F.lit(17)) == 0, None).otherwise(F.col("qty")).alias("Baseline_Scores_Qty_cont"),
        F.col("n_lines").alias("Baseline_Number.of.grps.previously"),
        F.datediff(F.col("last_ship").cast("date"), F.col("o_orderdate").cast("date")).alias("Days_Followup"),
    ]
    for suffix, _ in HORIZONS:
        cols.append(F.col(f"ip_{suffix}").alias(f"Outcome.Inpatient.visit.any_{suffix}"))
        cols.append(F.when(F.pmod("o_orderkey", F.lit(13)) == 0, None)
                    .otherwise(F.col(f"rc_{suffix}")).alias(f"Outcome.Regimen.change_{suffix}"))
    return j.select(*cols)


def _cohort_outcomes_sql() -> str:
    parts = []
    for suffix, days in HORIZONS:
        within = f"(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND {days})"
        parts.append(f"MAX(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_returnflag = 'R' AND {within} THEN 1 ELSE 0 END) AS ip_{suffix}")
        parts.append(f"MAX(CASE WHEN l_orderkey IS NULL THEN NULL WHEN l_linestatus = 'O' AND {within} THEN 1 ELSE 0 END) AS rc_{suffix}")
    return ",\n       ".join(parts)


def _cohort_sql() -> str:
    outs = []
    for suffix, _ in HORIZONS:
        months = suffix.replace("mo", "").rjust(2, "0") + "mo"
        outs.append(f"ip_{suffix} AS \"outcome_ip.visit.any.{months}\"")
        outs.append(f"CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE rc_{suffix} END AS \"outcome_regimen.change.{months}\"")
    outs_sql = ",\n       ".join(outs)
    return f"""
SELECT o_orderkey AS patient_id, r_name AS src, o_orderpriority AS intervention_raw,
       CAST(year(o_orderdate) AS INTEGER) AS index_year,
       dob,
       CAST(date_diff('day', dob, CAST(o_orderdate AS DATE)) AS INTEGER) AS index_off,
       c_custkey AS zip_raw,
       {_pick_sql(ETHNICITIES, 'c_custkey % 4')} AS ethnicity_raw,
       CAST(floor(date_diff('day', dob, CAST(o_orderdate AS DATE)) / 365.25) AS INTEGER) AS age,
       o_totalprice AS baseline_totalprice,
       c_acctbal AS cci_acctbal,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE qty END AS baseline_qty,
       n_lines AS "baseline_prior.med.groups",
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE)) AS INTEGER) AS days_followup,
       {outs_sql}
FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
         COUNT(l_orderkey) AS n_lines, SUM(l_quantity) AS qty, MAX(l_shipdate) AS last_ship,
         {_cohort_outcomes_sql()}
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority
) po
JOIN (SELECT c_custkey, c_nationkey, c_acctbal,
             CAST(DATE '1940-01-01' + CAST(c_custkey % 9000 AS INTEGER) AS DATE) AS dob FROM customer) c
  ON po.o_custkey = c.c_custkey
JOIN nation ON c.c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""


COHORT_BASE_SQL = _cohort_sql()
