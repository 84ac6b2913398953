"""Cohort queries over V_cohort: clean-up, profiling, Table One, SMD, splits,
effects and multi-class metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h, h_sql, in_train_sql, stream_sql, unit_hash_sql
from ..functions.rules import INTERVENTION_RECODE_RULES, replace_rules_sql
from ..operators import cohort as co
from ..operators.roles import column_roles, role_table
from ..operators import effects, metrics, split, stats, tableone
from ..sources.tables import table
from .inputs import COHORT_BASE_SQL, cohort_raw
from .registry import q, query, r6
from ..session import scratch_path
from ..sources import files

# ------------------------------------------------------------ run parameters
SPLIT_SEED = 1221
N_SEEDS = 100
TRAIN_PCT = 0.70
SCORE_SEED = 7
# Focus targets and treatment level with their weights in the split search.
FOCUS_TARGETS = {"outcome_ip.visit.or.regimen.change.12mo": 2.0, "years_followup_ge1": 2.0,
                 "outcome_ip.visit.any.12mo": 1.0, "outcome_regimen.change.12mo": 1.0}
FOCUS_INTERVENTION = {"1-URGENT": 2.0}
AIPW_TARGET = "outcome_ip.visit.or.regimen.change.12mo"
STRATA = ["src", "index_year"]
CONTINUOUS = ["age", "baseline_totalprice", "cci_acctbal", "baseline_qty", "baseline_prior.med.groups",
              "years_followup"]
CATEGORICAL = ["outcome_ip.visit.or.regimen.change.12mo", "outcome_ip.visit.any.12mo",
               "outcome_regimen.change.12mo", "years_followup_ge1", "src", "ethnicity", "index_year"]
HORIZONS = ("03mo", "06mo", "12mo")


def cohort(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """The cleaned cohort, checkpointed; ``columns`` limits what is kept."""
    return co.clean_cohort(cohort_raw(spark, sf), keep=columns)


# ------------------------------------------------------------ SQL twin of the clean cohort
def _cohort_sql() -> str:
    outs = []
    for hz in HORIZONS:
        outs += [f'"outcome_ip.visit.any.{hz}"', f'"outcome_regimen.change.{hz}"']
    comp = ",\n         ".join(
        f'CAST(("outcome_ip.visit.any.{hz}" = 1 OR "outcome_regimen.change.{hz}" = 1) AS INTEGER) '
        f'AS "outcome_ip.visit.or.regimen.change.{hz}"' for hz in HORIZONS)
    recode = replace_rules_sql("intervention_raw", INTERVENTION_RECODE_RULES)
    return f"""WITH cohort_base AS ({COHORT_BASE_SQL}),
cohort AS (
  SELECT patient_id, src, {recode} AS intervention, index_year, dob,
         CAST(dob + index_off AS DATE) AS index_date,
         lpad(CAST(zip_raw AS VARCHAR), CAST((SELECT max(length(CAST(zip_raw AS VARCHAR))) FROM cohort_base) AS INTEGER), '0') AS zip,
         CASE WHEN ethnicity_raw IS NULL OR NOT contains(ethnicity_raw, 'HISPANIC') THEN 'Unknown'
              WHEN contains(ethnicity_raw, 'NOT') THEN 'Not Hispanic or Latino'
              WHEN regexp_matches(ethnicity_raw, 'Not|Unk') THEN ethnicity_raw
              ELSE 'Hispanic or Latino' END AS ethnicity,
         age, baseline_totalprice, cci_acctbal, baseline_qty, "baseline_prior.med.groups",
         days_followup / 365.25 AS years_followup,
         {", ".join(outs)},
         CASE WHEN days_followup IS NULL THEN NULL WHEN days_followup / 365.25 >= 1 THEN 1 ELSE 0 END AS years_followup_ge1,
         {comp}
  FROM cohort_base
)"""


CO = _cohort_sql()


def _qid(name: str) -> str:
    return f'"{name}"'


# ------------------------------------------------------------ clean-up
@query("cohort_clean", sql=CO + "\nSELECT * FROM cohort")
def cohort_clean(spark, sf):
    d = cohort(spark, sf)
    # Column roles (ids, targets, treatment, predictors, the rest) order the output.
    roles = column_roles(d.columns)
    ordered = list(dict.fromkeys(roles.identifiers + roles.treatment + roles.table_one + d.columns))
    return d.select(*[q(n) for n in ordered])


#: The cohort's columns by role and place, written out for the SQL.
_ROLE_ROWS = {
    "identifier": ["src", "patient_id", "index_date"],
    "treatment": ["intervention"],
    "outcome": ["outcome_ip.visit.or.regimen.change.12mo", "outcome_ip.visit.any.12mo", "outcome_regimen.change.12mo"],
    "other_outcome": ["outcome_ip.visit.or.regimen.change.06mo", "outcome_ip.visit.any.06mo", "outcome_ip.visit.or.regimen.change.03mo",
                      "outcome_ip.visit.any.03mo", "outcome_regimen.change.06mo", "outcome_regimen.change.03mo"],
    "predictor": ["age", "index_year", "cci_acctbal", "ethnicity", "baseline_totalprice", "baseline_qty",
                  "baseline_prior.med.groups", "years_followup", "years_followup_ge1"],
    "excluded": ["dob", "zip"],
    "table_one": ["outcome_ip.visit.or.regimen.change.12mo", "outcome_ip.visit.any.12mo", "outcome_regimen.change.12mo",
                  "years_followup_ge1", "src", "age", "index_year", "cci_acctbal", "ethnicity", "baseline_totalprice",
                  "baseline_qty", "baseline_prior.med.groups", "years_followup"],
}
_ROLE_VALUES = ", ".join(f"('{role}', {k}, '{n}')" for role, names in _ROLE_ROWS.items() for k, n in enumerate(names, 1))
_FILLED = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(COUNT({_qid(n)}) AS BIGINT) AS n_known FROM cohort"
                             for n in dict.fromkeys(x for names in _ROLE_ROWS.values() for x in names))


@query("column_roles", sql=CO + f""",
roles AS (SELECT * FROM (VALUES {_ROLE_VALUES}) t(role, position, name)),
filled AS ({_FILLED})
SELECT role, position, name, n_known FROM roles JOIN filled USING (name)""")
def column_roles_query(spark, sf):
    """Every column of the cohort by role and place, with how many rows have a value in it."""
    d = cohort(spark, sf)
    counts = d.agg(*[F.count(q(n)).alias(n) for n in d.columns])
    filled = counts.unpivot([], [q(n) for n in d.columns], "name", "n_known")
    roles = column_roles(d.columns)
    named = role_table(d, roles).withColumn("role", F.regexp_replace("role", "s$", ""))
    return named.join(filled, "name").select("role", "position", "name", "n_known")


@query("source_filter", sql=CO + """
SELECT src, CAST(COUNT(*) AS BIGINT) AS n FROM cohort WHERE lower(src) IN ('asia', 'europe') GROUP BY src""")
def source_filter(spark, sf):
    """Rows of the sources asked for, in any case (F2)."""
    kept = co.filter_sources(cohort(spark, sf, ["src"]), ["Asia", "EUROPE"])
    return kept.groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query("recode_category", sql=f"""
WITH parts AS (
  SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'REF_' ELSE 'INTERVENTION_' END
         || upper(replace(p_name, ' ', '.')) || '.' || p_type || '.ANTIPSYCHOTIC' AS raw FROM part
)
SELECT p_partkey, raw, {replace_rules_sql('raw', INTERVENTION_RECODE_RULES)} AS recoded FROM parts""")
def recode_category(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    raw = F.concat(F.when(F.pmod("p_size", F.lit(5)) == 0, F.lit("REF_")).otherwise(F.lit("INTERVENTION_")),
                   F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("."))), F.lit("."), F.col("p_type"),
                   F.lit(".ANTIPSYCHOTIC"))
    parts = p.select("p_partkey", raw.alias("raw"))
    return co.recode_via_distinct(parts, "raw", "recoded").select("p_partkey", "raw", "recoded")


@query("normalise_category", sql=f"""WITH cohort_base AS ({COHORT_BASE_SQL})
SELECT ethnicity_raw,
       CASE WHEN ethnicity_raw IS NULL OR NOT contains(ethnicity_raw, 'HISPANIC') THEN 'Unknown'
            WHEN contains(ethnicity_raw, 'NOT') THEN 'Not Hispanic or Latino'
            WHEN regexp_matches(ethnicity_raw, 'Not|Unk') THEN ethnicity_raw
            ELSE 'Hispanic or Latino' END AS ethnicity,
       CAST(COUNT(*) AS BIGINT) AS n
FROM cohort_base GROUP BY ethnicity_raw""")
def normalise_category(spark, sf):
    raw = cohort_raw(spark, sf).select(F.col("Ethnicity").alias("ethnicity_raw"))
    return (raw.groupBy("ethnicity_raw").agg(F.count(F.lit(1)).alias("n"))
               .select("ethnicity_raw", co.normalise_ethnicity(F.col("ethnicity_raw")).alias("ethnicity"), "n"))


@query("pad_code", sql=CO + "\nSELECT patient_id, zip FROM cohort")
def pad_code(spark, sf):
    return cohort(spark, sf, ["patient_id", "zip"]).select("patient_id", "zip")


@query("date_offset", sql=CO + "\nSELECT patient_id, dob, index_date FROM cohort")
def date_offset(spark, sf):
    return cohort(spark, sf, ["patient_id", "dob", "index_date"]).select("patient_id", "dob", "index_date")


_COMPOSITE = ", ".join(_qid(f"outcome_ip.visit.or.regimen.change.{hz}") for hz in HORIZONS)


@query("composite_outcome", sql=CO + f"""
SELECT patient_id, years_followup, years_followup_ge1, {_COMPOSITE} FROM cohort WHERE years_followup_ge1 = 1""")
def composite_outcome(spark, sf):
    keep = ["patient_id", "years_followup", "years_followup_ge1"] + [f"outcome_ip.visit.or.regimen.change.{hz}"
                                                                    for hz in HORIZONS]
    d = cohort(spark, sf, keep).filter(F.col("years_followup_ge1") == 1)
    return d.select("patient_id", "years_followup", "years_followup_ge1",
                    *[q(f"outcome_ip.visit.or.regimen.change.{hz}") for hz in HORIZONS])


# Years kept by the extract's row filter (S6, F1): the study window.
STUDY_YEARS = [1996, 1997, 1998, 1999, 2000]


@query("cohort_years", sql=CO + f"""
SELECT index_year, intervention, CAST(COUNT(*) AS BIGINT) AS n_patients,
       CAST(COUNT(baseline_qty) AS BIGINT) AS n_qty
FROM cohort WHERE index_year IN ({", ".join(map(str, STUDY_YEARS))})
GROUP BY index_year, intervention""")
def cohort_years(spark, sf):
    """The cleaned cohort landed as Parquet partitioned by index year, then
    read back with the study-year filter: the filter becomes a partition
    filter, so years outside the window are never read."""
    path = scratch_path(spark, "cohort-by-year")
    files.write_partitioned(cohort(spark, sf, ["patient_id", "index_year", "intervention", "baseline_qty"]),
                            path, "index_year")
    landed = spark.read.parquet(path).filter(F.col("index_year").isin(STUDY_YEARS))
    return (landed.groupBy(F.col("index_year").cast("int").alias("index_year"), "intervention")
                  .agg(F.count(F.lit(1)).alias("n_patients"), F.count("baseline_qty").alias("n_qty")))


# ------------------------------------------------------------ matrices and codes
_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_TGT = list(FOCUS_TARGETS)
_TGT_SQL = ", ".join(_qid(t) for t in _TGT)
_COMPLETE_SQL = " AND ".join(f"{_qid(t)} IS NOT NULL" for t in _TGT + ["intervention"])


def _one_hot(spark, sf):
    d = cohort(spark, sf, ["patient_id", "intervention", *_TGT]).select("patient_id", "intervention",
                                                                        *[q(t) for t in _TGT])
    d = d.filter(" AND ".join(f"`{t}` IS NOT NULL" for t in _TGT))
    return co.one_hot(d, "intervention")


_ONEHOT_SQL = CO + f""",
onehot AS (
  SELECT patient_id, {_TGT_SQL},
         {", ".join(f"CAST(intervention = '{v}' AS INTEGER) AS {_qid(v)}" for v in _LEVELS)}
  FROM cohort WHERE {_COMPLETE_SQL}
)"""


@query("one_hot", sql=_ONEHOT_SQL + "\nSELECT * FROM onehot")
def one_hot(spark, sf):
    return _one_hot(spark, sf).drop("intervention")


@query("marginal_means", sql=_ONEHOT_SQL + "\nSELECT variable, mean FROM (UNPIVOT (SELECT " + ", ".join(
    f"SUM({_qid(v)}) / COUNT(*) AS {_qid(v)}" for v in _TGT + _LEVELS) + " FROM onehot) ON COLUMNS(*) INTO NAME variable VALUE mean)")
def marginal_means(spark, sf):
    d = _one_hot(spark, sf)
    cols = _TGT + [v for v in _LEVELS if v in d.columns]
    wide = d.agg(*[(F.sum(q(v)) / F.count(F.lit(1))).alias(v) for v in cols])
    return wide.unpivot([], [q(v) for v in cols], "variable", "mean")


@query("category_codes", sql=CO + """
SELECT patient_id, intervention, CAST(dense_rank() OVER (ORDER BY intervention) - 1 AS INTEGER) AS code FROM cohort""")
def category_codes(spark, sf):
    return co.category_codes(cohort(spark, sf, ["patient_id", "intervention"]), "intervention", "code")


_PROFILE_COLS = ["src", "intervention", "index_year", "ethnicity", "age", "baseline_totalprice", "cci_acctbal",
                 "baseline_qty", "baseline_prior.med.groups", "years_followup", "years_followup_ge1",
                 "outcome_ip.visit.any.12mo", "outcome_regimen.change.12mo", "outcome_ip.visit.or.regimen.change.12mo"]


def _profile_sql() -> str:
    parts = []
    for n in _PROFILE_COLS:
        qn = _qid(n)
        numeric = n not in ("src", "intervention", "ethnicity")
        is01 = f"bool_and({qn} IN (0, 1)) FILTER (WHERE {qn} IS NOT NULL)" if numeric else "NULL"
        cat = "1" if not numeric else f"CAST(coalesce({is01}, TRUE) AS INTEGER)"
        parts.append(f"""SELECT '{n}' AS "column", CAST(COUNT(*) AS BIGINT) AS n_rows,
  CAST(COUNT(*) - COUNT({qn}) AS BIGINT) AS n_missing, CAST(COUNT(DISTINCT {qn}) AS BIGINT) AS n_distinct,
  (COUNT(*) - COUNT({qn})) / COUNT(*) AS missing_share, {cat} AS is_categorical,
  CAST(COUNT(*) = COUNT({qn}) AS INTEGER) AS complete FROM cohort""")
    return CO + "\n" + "\nUNION ALL\n".join(parts)


@query("column_profile", sql=_profile_sql())
def column_profile(spark, sf):
    p = co.column_profile(cohort(spark, sf, _PROFILE_COLS), _PROFILE_COLS)
    return p.select("column", "n_rows", "n_missing", "n_distinct", "missing_share",
                    F.col("is_categorical").cast("int").alias("is_categorical"),
                    F.col("complete").cast("int").alias("complete"))


@query("complete_columns", sql=f"SELECT \"column\", complete FROM ({_profile_sql()}) WHERE complete = 1")
def complete_columns(spark, sf):
    d = cohort(spark, sf, _PROFILE_COLS)
    keep = co.complete_columns(d, _PROFILE_COLS)
    return spark.createDataFrame([(n, 1) for n in keep], "column string, complete int") if keep else \
        spark.createDataFrame([], "column string, complete int")


@query("frequency_table", sql=CO + """
SELECT intervention, CAST(COUNT(*) AS BIGINT) AS Freq FROM cohort WHERE intervention IS NOT NULL GROUP BY intervention""")
def frequency_table(spark, sf):
    return co.frequency_table(cohort(spark, sf, ["intervention"]), "intervention")


@query("contingency_share", sql=CO + """
, cnt AS (SELECT intervention AS "row", "baseline_prior.med.groups" AS "col", CAST(COUNT(*) AS BIGINT) AS n
          FROM cohort WHERE intervention IS NOT NULL AND "baseline_prior.med.groups" IS NOT NULL GROUP BY 1, 2)
SELECT "row", "col", n, n / SUM(n) OVER (PARTITION BY "row") AS share FROM cnt""")
def contingency_share(spark, sf):
    return co.contingency_share(cohort(spark, sf, ["intervention", "baseline_prior.med.groups"]), "intervention",
                                "baseline_prior.med.groups")


@query("quantiles", sql="\nUNION ALL\n".join(
    f"SELECT o_orderstatus, CAST(COUNT(*) AS BIGINT) AS n, CAST({p} AS DOUBLE) AS p, "
    f"round(quantile_cont(o_totalprice, {p}), 6) AS q FROM orders GROUP BY o_orderstatus"
    for p in (0.025, 0.5, 0.975)))
def quantiles(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    out = stats.exact_quantiles(o, "o_orderstatus", "o_totalprice", [0.025, 0.5, 0.975])
    return out.select("o_orderstatus", "n", "p", r6("q"))


# ------------------------------------------------------------ Table One and SMD
def _strat_sql(where: str = "WHERE years_followup_ge1 = 1") -> str:
    return CO + f",\nt1 AS (SELECT * FROM cohort {where})"


_T1_COLUMNS = ["intervention", "years_followup_ge1", *CONTINUOUS, *CATEGORICAL]


def _t1(spark, sf):
    return cohort(spark, sf, _T1_COLUMNS).filter(F.col("years_followup_ge1") == 1)


def _cont_ctes(variables: list[str] = CONTINUOUS) -> str:
    from ..functions.exact import fixed_sql
    rows = []
    for v in variables:
        xs = fixed_sql(_qid(v))
        rows.append(f"""SELECT intervention AS stratum, '{v}' AS variable, COUNT({_qid(v)}) AS n,
  CAST(SUM({xs}) AS DOUBLE) AS s1, CAST(SUM({xs} * {xs}) AS DOUBLE) AS s2, COUNT(*) AS n_all
  FROM t1 GROUP BY intervention""")
    return "cont_m AS (" + "\nUNION ALL\n".join(rows) + """),
cont AS (
  SELECT stratum, variable, n, s1 / n / 1000000.0 AS mean,
         sqrt(CASE WHEN n > 1 THEN greatest((s2 - (s1 * s1) / n) / (n - 1), 0.0) / 1000000000000.0 END) AS sd,
         (n_all - n) * 100.0 / n_all AS missing_pct
  FROM cont_m
)"""


def _cont_sql() -> str:
    return _strat_sql() + ",\n" + _cont_ctes()


@query("table_one_continuous", sql=_cont_sql() + """
SELECT stratum, variable, CAST(n AS BIGINT) AS n, mean, round(sd, 6) AS sd, missing_pct FROM cont""")
def table_one_continuous(spark, sf):
    t = tableone.continuous(_t1(spark, sf), "intervention", CONTINUOUS)
    return t.select("stratum", "variable", "n", "mean", r6("sd"), "missing_pct")


def _cat_ctes(variables: list[str] = CATEGORICAL) -> str:
    rows = []
    for v in variables:
        val = f"'y' || CAST({_qid(v)} AS VARCHAR)" if v == "index_year" else f"CAST({_qid(v)} AS VARCHAR)"
        rows.append(f"SELECT intervention AS stratum, '{v}' AS variable, coalesce({val}, 'NA') AS level FROM t1")
    return "cat_long AS (" + "\nUNION ALL\n".join(rows) + """),
sizes AS (SELECT intervention AS stratum, COUNT(*) AS n_stratum FROM t1 GROUP BY intervention),
cat AS (
  SELECT l.stratum, l.variable, l.level, CAST(COUNT(*) AS BIGINT) AS n, COUNT(*) * 100.0 / s.n_stratum AS pct
  FROM cat_long l JOIN sizes s ON l.stratum = s.stratum
  GROUP BY l.stratum, l.variable, l.level, s.n_stratum
)"""


def _cat_sql() -> str:
    return _strat_sql() + ",\n" + _cat_ctes()


def _t1_cat(spark, sf):
    d = _t1(spark, sf)
    return d.withColumn("index_year", F.concat(F.lit("y"), F.col("index_year").cast("string")))


@query("table_one_categorical", sql=_cat_sql() + "\nSELECT stratum, variable, level, n, pct FROM cat")
def table_one_categorical(spark, sf):
    return tableone.categorical(_t1_cat(spark, sf), "intervention", CATEGORICAL)


_SMD_C = """pairs_c AS (
  SELECT a.variable, CASE WHEN sqrt((a.sd * a.sd + b.sd * b.sd) / 2.0) > 0
         THEN abs(a.mean - b.mean) / sqrt((a.sd * a.sd + b.sd * b.sd) / 2.0) END AS d
  FROM cont a JOIN cont b ON a.variable = b.variable AND a.stratum < b.stratum
),
smd_c AS (SELECT variable, AVG(d) AS smd, CAST(COUNT(*) AS BIGINT) AS n_pairs FROM pairs_c GROUP BY variable)"""


@query("smd_continuous", sql=_cont_sql() + ",\n" + _SMD_C + """
SELECT variable, round(smd, 6) AS smd, n_pairs FROM smd_c""")
def smd_continuous(spark, sf):
    t = tableone.continuous(_t1(spark, sf), "intervention", CONTINUOUS)
    return tableone.smd_continuous(t).select("variable", r6("smd"), "n_pairs")


_SMD_K = """strata_k AS (SELECT DISTINCT variable, stratum FROM cat),
lv_k AS (SELECT DISTINCT variable, level FROM cat),
shares_k AS (
  SELECT g.variable, g.stratum, g.level, coalesce(c.pct / 100.0, 0.0) AS p
  FROM (SELECT s.variable, s.stratum, l.level FROM strata_k s JOIN lv_k l ON s.variable = l.variable) g
  LEFT JOIN cat c ON g.variable = c.variable AND g.stratum = c.stratum AND g.level = c.level
),
per_pair_k AS (
  SELECT a.variable, a.stratum AS sa, b.stratum AS sb,
         SUM(CASE WHEN a.p + b.p > 0 THEN (a.p - b.p) * (a.p - b.p) / ((a.p + b.p) / 2.0) ELSE 0.0 END) AS cc
  FROM shares_k a JOIN shares_k b ON a.variable = b.variable AND a.level = b.level AND a.stratum < b.stratum
  GROUP BY a.variable, a.stratum, b.stratum
),
smd_k AS (
  SELECT variable, AVG(CASE WHEN cc < 4.0 THEN sqrt(cc / (1.0 - cc / 4.0)) END) AS smd,
         CAST(COUNT(*) AS BIGINT) AS n_pairs
  FROM per_pair_k GROUP BY variable
)"""


@query("smd_categorical", sql=_cat_sql() + ",\n" + _SMD_K + """
SELECT variable, round(smd, 6) AS smd, n_pairs FROM smd_k""")
def smd_categorical(spark, sf):
    t = tableone.categorical(_t1_cat(spark, sf), "intervention", CATEGORICAL)
    return tableone.smd_categorical(t).select("variable", r6("smd"), "n_pairs")


REPORT_LABEL = "Source=all years_followup_ge1"


def _report_sql(start: str, cont: list[str], cat: list[str], kept: str = "TRUE") -> str:
    strata_cols = ", ".join(f"MAX(CASE WHEN stratum = '{v}' THEN cell END) AS {_qid(v)}" for v in _LEVELS)
    sel = ", ".join(f"w.{_qid(v)}" for v in _LEVELS)
    return (start + ",\n" + _cont_ctes(cont) + ",\n" + _cat_ctes(cat) + ",\n" + _SMD_C + ",\n" + _SMD_K + f""",
smd_all AS (SELECT variable, smd FROM smd_c UNION ALL SELECT variable, smd FROM smd_k),
missing_all AS (
  SELECT variable, SUM(n_all - n) * 100.0 / SUM(n_all) AS missing FROM cont_m GROUP BY variable
  UNION ALL SELECT variable, SUM(CASE WHEN level = 'NA' THEN n ELSE 0 END) * 100.0 / SUM(n) FROM cat GROUP BY variable),
kept AS (SELECT variable FROM smd_all WHERE {kept}),
long_ AS (
  SELECT 'n' AS row_, '' AS variable, stratum, CAST(n_stratum AS VARCHAR) AS cell FROM sizes
  UNION ALL
  SELECT variable || ' (mean (SD))', variable, stratum,
         coalesce(printf('%.2f', round(mean, 2)), 'NA') || ' (' || coalesce(printf('%.2f', round(sd, 2)), 'NA') || ')'
  FROM cont WHERE variable IN (SELECT variable FROM kept)
  UNION ALL
  SELECT variable || ' (%) = ' || level, variable, stratum,
         printf('%d', n) || ' (' || printf('%.1f', round(pct, 1)) || ')'
  FROM cat WHERE variable IN (SELECT variable FROM kept)
),
wide AS (SELECT row_, variable, {strata_cols} FROM long_ GROUP BY row_, variable)
SELECT w.row_ AS "{REPORT_LABEL}", {sel},
       CASE WHEN s.smd IS NULL THEN NULL ELSE printf('%.3f', round(s.smd, 3)) END AS SMD,
       printf('%.1f', round(m.missing, 1)) AS Missing
FROM wide w LEFT JOIN smd_all s ON w.variable = s.variable LEFT JOIN missing_all m ON w.variable = m.variable""")


def _printed(spark, wide: DataFrame) -> DataFrame:
    """Table One as exported: written as TSV with the row label moved first under
    a chosen header (K1, K2) and read back."""
    path = scratch_path(spark, "table-one")
    files.write_tsv(wide.drop("variable"), path, first_column="row", label=REPORT_LABEL)
    cols = [c for c in wide.columns if c not in ("row", "variable")]
    schema = ", ".join([f"`{REPORT_LABEL}` STRING"] + [f"`{c}` STRING" for c in cols])
    return files.read_delimited(spark, path, schema).drop("source_file")


def _prefixed(d: DataFrame, name: str, prefix: str) -> DataFrame:
    """Numbers that are labels: a prefix makes them levels."""
    return d.withColumn(name, F.concat(F.lit(prefix), F.coalesce(q(name).cast("string"), F.lit("NA"))))


@query("table_one_report", sql=_report_sql(_strat_sql(), CONTINUOUS, CATEGORICAL))
def table_one_report(spark, sf):
    """Table One of the variables that the column roles name: n, mean (SD) or n (%)
    per level, one column per stratum, SMD, missing share."""
    d = _prefixed(_t1(spark, sf), "index_year", "y")
    return _printed(spark, tableone.report(d, "intervention", column_roles(d.columns).table_one))


N_FEATURES = 4  # predictors that the second table shows (its length is the feature)
PRIOR = "baseline_prior.med.groups"
_FEATURE_CONT = [v for v in CONTINUOUS if v != PRIOR]
_FEATURE_CAT = CATEGORICAL + [PRIOR]
_SHOWN = [*[n for n in FOCUS_TARGETS if n in CATEGORICAL], PRIOR]


def _features_sql() -> str:
    start = CO + f""",
t1 AS (SELECT * REPLACE ('c' || coalesce(CAST({_qid(PRIOR)} AS VARCHAR), 'NA') AS {_qid(PRIOR)}) FROM cohort WHERE years_followup_ge1 = 1)"""
    shown = ", ".join(f"'{v}'" for v in _SHOWN)
    rest = ", ".join(f"'{v}'" for v in _ROLE_ROWS["predictor"] if v not in _SHOWN)
    return _report_sql(start, _FEATURE_CONT, _FEATURE_CAT, f"""variable IN ({shown}) OR variable IN (
  SELECT variable FROM smd_all WHERE smd IS NOT NULL AND variable IN ({rest}) ORDER BY round(smd, 9) DESC, variable LIMIT {N_FEATURES})""")


@query("table_one_features", sql=_features_sql())
def table_one_features(spark, sf):
    """The second table: the focus targets, earlier medication groups as levels, and the
    predictors that tell the strata apart best (by SMD, the measure of the table itself)."""
    d = _prefixed(_prefixed(_t1(spark, sf), "index_year", "y"), PRIOR, "c")
    roles = column_roles(d.columns)
    others = [n for n in roles.predictors if n not in _SHOWN]

    def keep(smd: DataFrame) -> DataFrame:
        best = smd.filter(F.col("smd").isNotNull() & F.col("variable").isin(others)) \
            .orderBy(F.round("smd", 9).desc(), "variable").limit(N_FEATURES)
        return best.unionByName(smd.filter(F.col("variable").isin(_SHOWN)))

    return _printed(spark, tableone.report(d, "intervention", roles.table_one, keep=keep))


# ------------------------------------------------------------ splits
def _search_vars() -> dict[str, float]:
    out = dict(FOCUS_TARGETS)
    for lv in _LEVELS:
        out[lv] = FOCUS_INTERVENTION.get(lv, 1.0)
    return out


def _search_sql() -> str:
    vs = _search_vars()
    names = list(vs)
    sums = ", ".join(
        f"SUM(CAST({_qid(n)} AS DOUBLE)) AS all{i}, SUM(CASE WHEN tr THEN CAST({_qid(n)} AS DOUBLE) END) AS tr{i}"
        for i, n in enumerate(names))
    terms = " + ".join(
        f"abs({float(vs[n])} * (all{i} / n_all) - {float(vs[n])} * (tr{i} / n_train))" for i, n in enumerate(names))
    return _ONEHOT_SQL + f""",
ex AS (SELECT *, seed, {in_train_sql('seed', 'patient_id', TRAIN_PCT)} AS tr
       FROM onehot, range(1, {N_SEEDS + 1}) t(seed)),
per_seed AS (SELECT seed, CAST(COUNT(*) AS BIGINT) AS n_all, CAST(SUM(CAST(tr AS INTEGER)) AS BIGINT) AS n_train, {sums}
             FROM ex GROUP BY seed),
scored AS (SELECT seed, n_all, n_train, {terms} AS score FROM per_seed)
SELECT CAST(seed AS INTEGER) AS seed, n_all, n_train, score,
       CAST(row_number() OVER (ORDER BY score, seed) = 1 AS INTEGER) AS is_best
FROM scored"""


@query("split_seed_search", sql=_search_sql())
def split_seed_search(spark, sf):
    d = _one_hot(spark, sf)
    out = split.split_seed_search(d, "patient_id", _search_vars(), list(range(1, N_SEEDS + 1)), TRAIN_PCT)
    return out.select(F.col("seed").cast("int").alias("seed"), "n_all", "n_train", "score", "is_best")


def best_seed(spark: SparkSession, sf: str) -> int:
    """The seed of the best balanced split."""
    return split_seed_search(spark, sf).filter(F.col("is_best") == 1).first()["seed"]


_BEST = f"""WITH search AS ({_search_sql()}),
best AS (SELECT seed FROM search WHERE is_best = 1),
{CO.removeprefix("WITH ")}"""
BEST_SEED = "(SELECT seed FROM best)"


@query("hash_split", sql=_BEST + f"""
SELECT patient_id, CASE WHEN {in_train_sql(BEST_SEED, 'patient_id', TRAIN_PCT)} THEN 'Train' ELSE 'Test' END AS "set"
FROM cohort""")
def hash_split(spark, sf):
    """About 0.70 n rows in Train, each by its own hash under the best seed."""
    return split.hash_split(cohort(spark, sf, ["patient_id"]), "patient_id", best_seed(spark, sf), TRAIN_PCT)


@query("exact_split", sql=_BEST + f""",
drawn AS (SELECT patient_id, {stream_sql(unit_hash_sql('patient_id'), BEST_SEED)} AS z FROM cohort)
SELECT patient_id, CASE WHEN row_number() OVER (ORDER BY z, patient_id) <= CAST(floor({TRAIN_PCT} * COUNT(*) OVER ()) AS BIGINT)
                        THEN 'Train' ELSE 'Test' END AS "set"
FROM drawn""")
def exact_split(spark, sf):
    """Exactly floor(0.70 n) rows in Train, drawn with the best seed."""
    return split.exact_size_split(cohort(spark, sf, ["patient_id"]), "patient_id", best_seed(spark, sf), TRAIN_PCT)


# ------------------------------------------------------------ effects
@query("ols_factor", sql=CO + """
, g AS (
  SELECT intervention AS level, COUNT(*) AS n,
         CAST(SUM(CAST(round(baseline_qty * 1000000.0) AS DECIMAL(38,0))) AS DOUBLE) AS m_s1,
         CAST(SUM(CAST(round(baseline_qty * 1000000.0) AS DECIMAL(38,0)) * CAST(round(baseline_qty * 1000000.0) AS DECIMAL(38,0))) AS DOUBLE) AS m_s2
  FROM cohort WHERE baseline_qty IS NOT NULL AND intervention IS NOT NULL GROUP BY intervention
),
g2 AS (
  SELECT level, n, m_s1 / n / 1000000.0 AS mean, (m_s2 - m_s1 * m_s1 / n) / (1000000.0 * 1000000.0) AS ss,
         m_s1 / 1000000.0 AS s1, m_s2 / (1000000.0 * 1000000.0) AS s2
  FROM g
),
j AS (
  SELECT *, SUM(n) OVER () AS n_tot, COUNT(*) OVER () AS k_tot, SUM(ss) OVER () AS ssw, SUM(s1) OVER () AS tot_s1,
         SUM(s2) OVER () AS tot_s2, FIRST_VALUE(level) OVER (ORDER BY level) AS ref_level,
         FIRST_VALUE(n) OVER (ORDER BY level) AS n_ref, FIRST_VALUE(mean) OVER (ORDER BY level) AS mean_ref
  FROM g2
),
k AS (
  SELECT *, sqrt(ssw / (n_tot - k_tot)) AS sigma, level = ref_level AS is_ref FROM j
),
e AS (
  SELECT CASE WHEN is_ref THEN '(Intercept)' ELSE 'W' || level END AS term,
         CASE WHEN is_ref THEN mean_ref ELSE mean - mean_ref END AS est,
         CASE WHEN is_ref THEN sigma / sqrt(CAST(n_ref AS DOUBLE)) ELSE sigma * sqrt(1.0 / n + 1.0 / n_ref) END AS se,
         CAST(n_tot AS BIGINT) AS n_obs, 1.0 - ssw / (tot_s2 - tot_s1 * tot_s1 / n_tot) AS r_squared
  FROM k
)
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 6) AS t_value, n_obs,
       round(r_squared, 6) AS r_squared FROM e""")
def ols_factor(spark, sf):
    out = effects.ols_factor(cohort(spark, sf, ["intervention", "baseline_qty"]), "baseline_qty", "intervention")
    return out.select("term", r6("estimate"), r6("std_error"), r6("t_value"), "n_obs", r6("r_squared"))


def _aipw_input(spark, sf):
    d = cohort(spark, sf, [*STRATA, "intervention", AIPW_TARGET])
    return d.withColumn("y_flip", F.lit(1) - q(AIPW_TARGET))


_AIPW_SQL = CO + f""",
d AS (SELECT src, index_year, intervention AS arm, 1 - {_qid(AIPW_TARGET)} AS y FROM cohort
      WHERE {_qid(AIPW_TARGET)} IS NOT NULL AND intervention IS NOT NULL),
cells AS (SELECT src, index_year, arm, COUNT(*) AS n_xk, AVG(y) AS mu FROM d GROUP BY ALL),
cells2 AS (SELECT *, SUM(n_xk) OVER (PARTITION BY src, index_year) AS n_x,
                  COUNT(*) OVER (PARTITION BY src, index_year) AS k_x FROM cells),
ok AS (SELECT *, n_xk / n_x AS e FROM cells2 WHERE k_x = (SELECT COUNT(DISTINCT arm) FROM d)),
ref AS (SELECT MIN(arm) AS ref_arm FROM d),
rows_ AS (
  SELECT d.*, c.n_x FROM d JOIN ok c ON d.src = c.src AND d.index_year = c.index_year AND d.arm = c.arm
),
gam AS (
  SELECT k.arm AS karm, r.src, r.index_year, r.y, r.arm AS warm,
         (mk.mu - m0.mu)
         + CASE WHEN r.arm = k.arm THEN (r.y - mk.mu) / mk.e ELSE 0.0 END
         - CASE WHEN r.arm = (SELECT ref_arm FROM ref) THEN (r.y - m0.mu) / m0.e ELSE 0.0 END AS dgam
  FROM rows_ r
  CROSS JOIN (SELECT DISTINCT arm FROM ok WHERE arm <> (SELECT ref_arm FROM ref)) k
  JOIN ok mk ON mk.src = r.src AND mk.index_year = r.index_year AND mk.arm = k.arm
  JOIN ok m0 ON m0.src = r.src AND m0.index_year = r.index_year AND m0.arm = (SELECT ref_arm FROM ref)
)"""


@query("aipw_stratified", sql=_AIPW_SQL + """
SELECT karm AS arm, (SELECT ref_arm FROM ref) AS reference, round(AVG(dgam), 6) AS estimate,
       round(stddev_samp(dgam) / sqrt(COUNT(*)), 6) AS std_err, CAST(COUNT(*) AS BIGINT) AS n
FROM gam GROUP BY karm""")
def aipw_stratified(spark, sf):
    out = effects.aipw_stratified(_aipw_input(spark, sf), "y_flip", "intervention", STRATA)
    return out.select("arm", "reference", r6("estimate"), r6("std_err"), F.col("n").cast("bigint").alias("n"))


# Rows and strata that each contrast keeps and leaves out.
@query("aipw_dropped", sql=CO + f""",
d AS (SELECT src, index_year, intervention AS arm FROM cohort
      WHERE {_qid(AIPW_TARGET)} IS NOT NULL AND intervention IS NOT NULL),
ref AS (SELECT MIN(arm) AS ref_arm FROM d),
arms AS (SELECT DISTINCT arm FROM d WHERE arm <> (SELECT ref_arm FROM ref)),
x AS (SELECT src, index_year, COUNT(*) AS n_x, list(DISTINCT arm) AS held FROM d GROUP BY src, index_year),
m AS (SELECT a.arm, x.n_x, list_contains(held, a.arm) AND list_contains(held, (SELECT ref_arm FROM ref)) AS ok
      FROM arms a CROSS JOIN x)
SELECT arm, (SELECT ref_arm FROM ref) AS reference,
       CAST(COALESCE(SUM(n_x) FILTER (WHERE ok), 0) AS BIGINT) AS n,
       CAST(COALESCE(SUM(n_x) FILTER (WHERE NOT ok), 0) AS BIGINT) AS n_dropped,
       CAST(COUNT(*) FILTER (WHERE ok) AS BIGINT) AS n_strata,
       CAST(COUNT(*) FILTER (WHERE NOT ok) AS BIGINT) AS strata_dropped
FROM m GROUP BY arm""")
def aipw_dropped(spark, sf):
    out = effects.aipw_stratified(_aipw_input(spark, sf), "y_flip", "intervention", STRATA)
    return out.select("arm", "reference", "n", "n_dropped", "n_strata", "strata_dropped")


@query("propensity_histogram", sql=CO + """
, cells AS (SELECT src, index_year, intervention AS arm, COUNT(*) AS n_xk FROM cohort
            WHERE intervention IS NOT NULL GROUP BY ALL),
c2 AS (SELECT *, SUM(n_xk) OVER (PARTITION BY src, index_year) AS n_x FROM cells),
c3 AS (SELECT *, n_xk / n_x AS e FROM c2)
SELECT arm, CAST(least(floor(e * 20.0), 19) AS INTEGER) AS bin, CAST(SUM(n_x) AS BIGINT) AS n_rows,
       MIN(e) AS e_min, MAX(e) AS e_max
FROM c3 GROUP BY arm, bin""")
def propensity_histogram(spark, sf):
    return effects.propensity_histogram(cohort(spark, sf, [*STRATA, "intervention"]), "intervention", STRATA)


# ------------------------------------------------------------ multi-class metrics
def _scores_wide(spark, sf, seed: int = SPLIT_SEED):
    d = cohort(spark, sf, ["patient_id", "intervention"]).filter(F.col("intervention").isNotNull())
    d = split.hash_split(d, "patient_id", seed, TRAIN_PCT)
    cols = []
    for k in _LEVELS:
        truth = (F.col("intervention") == k).cast("int")
        u = h(F.lit(SCORE_SEED), F.col("patient_id"), F.lit(k)) / F.lit(4294967296.0)
        pred = F.floor((F.lit(0.35) * truth + F.lit(0.65) * u) * F.lit(100.0)) / F.lit(100.0)
        cols += [truth.alias(f"{k}_true"), pred.alias(f"{k}_pred")]
    return d.select("patient_id", "set", *cols)


def _scores_sql(start: str = CO, seed: str = str(SPLIT_SEED)) -> str:
    cols = []
    for k in _LEVELS:
        truth = f"CAST(intervention = '{k}' AS INTEGER)"
        u = f"({h_sql(str(SCORE_SEED), 'patient_id', repr(k))} / 4294967296.0)"
        cols.append(f"{truth} AS {_qid(k + '_true')}")
        cols.append(f"floor((0.35 * {truth} + 0.65 * {u}) * 100.0) / 100.0 AS {_qid(k + '_pred')}")
    stack = "\nUNION ALL\n".join(
        f"SELECT patient_id AS id, \"set\" AS grp, '{k}' AS target, {_qid(k + '_true')} AS truth, "
        f"{_qid(k + '_pred')} AS score FROM wide" for k in _LEVELS)
    return start + f""",
wide AS (
  SELECT patient_id,
         CASE WHEN {in_train_sql(seed, 'patient_id', TRAIN_PCT)} THEN 'Train' ELSE 'Test' END AS "set",
         {", ".join(cols)}
  FROM cohort WHERE intervention IS NOT NULL
),
long AS ({stack}),
cnt AS (
  SELECT grp, target, score, SUM(truth) AS pos, SUM(1 - truth) AS neg FROM long GROUP BY grp, target, score
  UNION ALL
  SELECT grp, 'micro' AS target, score, SUM(truth) AS pos, SUM(1 - truth) AS neg FROM long GROUP BY grp, score
)"""


@query("multiclass_auroc", sql=_scores_sql() + """
, c2 AS (
  SELECT *, coalesce(SUM(neg) OVER (PARTITION BY grp, target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
         SUM(pos) OVER (PARTITION BY grp, target) AS P, SUM(neg) OVER (PARTITION BY grp, target) AS N
  FROM cnt
),
per AS (SELECT grp, target, SUM(pos * (neg_below + neg / 2.0)) / (CAST(MIN(P) AS DOUBLE) * CAST(MIN(N) AS DOUBLE)) AS auc
        FROM c2 GROUP BY grp, target)
SELECT grp, target, round(auc, 6) AS auc FROM per
UNION ALL
SELECT grp, 'macro' AS target, round(AVG(auc), 6) AS auc FROM per WHERE target <> 'micro' GROUP BY grp""")
def multiclass_auroc(spark, sf):
    long = metrics.stack_classes(_scores_wide(spark, sf), "patient_id", "set", _LEVELS)
    return metrics.auroc(long).select("grp", "target", r6("auc"))


@query("multiclass_auprc", sql=_scores_sql() + """
, c2 AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY grp, target) AS P
  FROM cnt WINDOW w AS (PARTITION BY grp, target ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
c3 AS (SELECT *, tp / P AS recall, tp / (tp + fp) AS prec FROM c2),
c4 AS (
  SELECT *, coalesce(lag(recall) OVER (PARTITION BY grp, target ORDER BY score DESC), 0.0) AS r_prev,
         coalesce(lag(prec) OVER (PARTITION BY grp, target ORDER BY score DESC), prec) AS p_prev
  FROM c3
),
per AS (SELECT grp, target, SUM((recall - r_prev) * (prec + p_prev) / 2.0) AS auprc FROM c4 GROUP BY grp, target)
SELECT grp, target, round(auprc, 6) AS auprc FROM per
UNION ALL
SELECT grp, 'macro' AS target, round(AVG(auprc), 6) AS auprc FROM per WHERE target <> 'micro' GROUP BY grp""")
def multiclass_auprc(spark, sf):
    long = metrics.stack_classes(_scores_wide(spark, sf), "patient_id", "set", _LEVELS)
    return metrics.auprc(long).select("grp", "target", r6("auprc"))


_AUC_CTES = """
, c2 AS (
  SELECT *, coalesce(SUM(neg) OVER (PARTITION BY grp, target ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
         SUM(pos) OVER (PARTITION BY grp, target) AS P, SUM(neg) OVER (PARTITION BY grp, target) AS N
  FROM cnt
),
per_roc AS (SELECT grp, target, SUM(pos * (neg_below + neg / 2.0)) / (CAST(MIN(P) AS DOUBLE) * CAST(MIN(N) AS DOUBLE)) AS auc
            FROM c2 GROUP BY grp, target),
roc AS (SELECT grp, target, auc FROM per_roc UNION ALL
        SELECT grp, 'macro', AVG(auc) FROM per_roc WHERE target <> 'micro' GROUP BY grp),
d2 AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY grp, target) AS P
  FROM cnt WINDOW w AS (PARTITION BY grp, target ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
d3 AS (SELECT *, tp / P AS recall, tp / (tp + fp) AS prec FROM d2),
d4 AS (
  SELECT *, coalesce(lag(recall) OVER (PARTITION BY grp, target ORDER BY score DESC), 0.0) AS r_prev,
         coalesce(lag(prec) OVER (PARTITION BY grp, target ORDER BY score DESC), prec) AS p_prev
  FROM d3
),
per_pr AS (SELECT grp, target, SUM((recall - r_prev) * (prec + p_prev) / 2.0) AS auprc FROM d4 GROUP BY grp, target),
pr AS (SELECT grp, target, auprc FROM per_pr UNION ALL
       SELECT grp, 'macro', AVG(auprc) FROM per_pr WHERE target <> 'micro' GROUP BY grp)"""


@query("auc_table", sql=_scores_sql(_BEST, BEST_SEED) + _AUC_CTES + """
SELECT r.target AS Target,
       round(MAX(CASE WHEN r.grp = 'Train' THEN r.auc END), 6) AS AUROC_Train,
       round(MAX(CASE WHEN r.grp = 'Test' THEN r.auc END), 6) AS AUROC_Valid,
       round(MAX(CASE WHEN p.grp = 'Train' THEN p.auprc END), 6) AS AUPRC_Train,
       round(MAX(CASE WHEN p.grp = 'Test' THEN p.auprc END), 6) AS AUPRC_Valid
FROM roc r JOIN pr p ON r.grp = p.grp AND r.target = p.target
GROUP BY r.target""")
def auc_table(spark, sf):
    """The model-evaluation table: one row per target (classes, micro,
    macro), ROC and PR AUC on the training and validation rows."""
    long = metrics.stack_classes(_scores_wide(spark, sf, best_seed(spark, sf)), "patient_id", "set", _LEVELS)
    both = metrics.auroc(long).join(metrics.auprc(long), ["grp", "target"])
    wide = both.groupBy(F.col("target").alias("Target")).agg(
        F.max(F.when(F.col("grp") == "Train", F.col("auc"))).alias("AUROC_Train"),
        F.max(F.when(F.col("grp") == "Test", F.col("auc"))).alias("AUROC_Valid"),
        F.max(F.when(F.col("grp") == "Train", F.col("auprc"))).alias("AUPRC_Train"),
        F.max(F.when(F.col("grp") == "Test", F.col("auprc"))).alias("AUPRC_Valid"))
    return wide.select("Target", *[r6(c) for c in ("AUROC_Train", "AUROC_Valid", "AUPRC_Train", "AUPRC_Valid")])


@query("unpivot_scores", sql=_scores_sql() + """
SELECT id AS patient_id, grp AS "set", target AS class, truth, score FROM long""")
def unpivot_scores(spark, sf):
    long = metrics.stack_classes(_scores_wide(spark, sf), "patient_id", "set", _LEVELS)
    return long.select(F.col("id").alias("patient_id"), F.col("grp").alias("set"), F.col("target").alias("class"),
                       "truth", "score")
