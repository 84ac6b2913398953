"""Table One by stratum and standardised mean differences (T4, T5).

Variables are unpivoted into (stratum, variable, value) so one aggregate
covers every variable; means and SDs come from exact fixed-point moments,
so they do not depend on partitioning. SMDs are closed forms on the
aggregated rows: pairs of strata are formed by an equi-join on the variable
(strata x strata per variable, never unit-level pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import fixed_moments, mean_from_moments, sd_from_moments
from .cohort import c, categorical_columns, levels


def continuous(df: DataFrame, strat: str, variables: Sequence[str]) -> DataFrame:
    """Per (stratum, variable): n non-missing, mean, sd (n-1), missing %."""
    long = df.select(c(strat).alias("stratum"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), c(v).cast("double").alias("x")) for v in variables])).alias("s"))
    long = long.select("stratum", "s.variable", "s.x")
    agg = long.groupBy("stratum", "variable").agg(
        *fixed_moments(F.col("x"), "m"), F.count(F.lit(1)).alias("n_all"))
    return agg.select(
        "stratum", "variable", F.col("m_n").alias("n"), (F.col("n_all") - F.col("m_n")).alias("n_missing"), "n_all",
        mean_from_moments(F.col("m_n"), F.col("m_s1")).alias("mean"),
        sd_from_moments(F.col("m_n"), F.col("m_s1"), F.col("m_s2")).alias("sd"),
        ((F.col("n_all") - F.col("m_n")) * F.lit(100.0) / F.col("n_all")).alias("missing_pct"))


def categorical(df: DataFrame, strat: str, variables: Sequence[str]) -> DataFrame:
    """Per (stratum, variable, level): count and % of the stratum; missing
    values are their own level 'NA' (includeNA)."""
    long = df.select(c(strat).alias("stratum"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.coalesce(c(v).cast("string"), F.lit("NA")).alias("level"))
        for v in variables])).alias("s"))
    cnt = (long.select("stratum", "s.variable", "s.level")
               .groupBy("stratum", "variable", "level").agg(F.count(F.lit(1)).alias("n")))
    sizes = df.groupBy(c(strat).alias("stratum")).agg(F.count(F.lit(1)).alias("n_stratum"))
    return (cnt.join(sizes, "stratum")
               .select("stratum", "variable", "level", "n",
                       (F.col("n") * F.lit(100.0) / F.col("n_stratum")).alias("pct")))


def smd_continuous(cont: DataFrame) -> DataFrame:
    """Mean over stratum pairs of |m1 - m2| / sqrt((s1^2 + s2^2) / 2)."""
    a = cont.select("variable", F.col("stratum").alias("sa"), F.col("mean").alias("ma"), F.col("sd").alias("va"))
    b = cont.select("variable", F.col("stratum").alias("sb"), F.col("mean").alias("mb"), F.col("sd").alias("vb"))
    pairs = a.join(b, "variable").filter(F.col("sa") < F.col("sb"))
    den = F.sqrt((F.col("va") * F.col("va") + F.col("vb") * F.col("vb")) / F.lit(2.0))
    d = F.when(den > 0, F.abs(F.col("ma") - F.col("mb")) / den)
    return pairs.groupBy("variable").agg(F.avg(d).alias("smd"), F.count(F.lit(1)).alias("n_pairs"))


def smd_categorical(cat: DataFrame) -> DataFrame:
    """Mahalanobis SMD of level shares (Yang & Dalton) in closed form:
    c = sum_l (p - q)^2 / ((p + q) / 2), SMD = sqrt(c / (1 - c / 4)); averaged
    over stratum pairs. Absent (stratum, level) cells count as share 0."""
    strata = cat.select("variable", "stratum").distinct()
    lv = cat.select("variable", "level").distinct()
    grid = strata.join(lv, "variable")
    shares = (grid.join(cat.select("variable", "stratum", "level", (F.col("pct") / F.lit(100.0)).alias("p")),
                        ["variable", "stratum", "level"], "left")
                  .fillna(0.0, subset=["p"]))
    a = shares.select("variable", "level", F.col("stratum").alias("sa"), F.col("p").alias("pa"))
    b = shares.select("variable", "level", F.col("stratum").alias("sb"), F.col("p").alias("pb"))
    pairs = a.join(b, ["variable", "level"]).filter(F.col("sa") < F.col("sb"))
    term = F.when((F.col("pa") + F.col("pb")) > 0,
                  (F.col("pa") - F.col("pb")) * (F.col("pa") - F.col("pb"))
                  / ((F.col("pa") + F.col("pb")) / F.lit(2.0))).otherwise(F.lit(0.0))
    per_pair = pairs.groupBy("variable", "sa", "sb").agg(F.sum(term).alias("cc"))
    smd = F.when(F.col("cc") < 4.0, F.sqrt(F.col("cc") / (F.lit(1.0) - F.col("cc") / F.lit(4.0))))
    return per_pair.groupBy("variable").agg(F.avg(smd).alias("smd"), F.count(F.lit(1)).alias("n_pairs"))


def smds(cont: DataFrame, cat: DataFrame) -> DataFrame:
    """(variable, smd) of all variables."""
    return smd_continuous(cont).select("variable", "smd").unionByName(smd_categorical(cat).select("variable", "smd"))


def missing_shares(cont: DataFrame, cat: DataFrame) -> DataFrame:
    """(variable, missing): missing values of a variable over all strata, in percent."""
    a = cont.groupBy("variable").agg((F.sum("n_missing") * F.lit(100.0) / F.sum("n_all")).alias("missing"))
    gone = F.sum(F.when(F.col("level") == "NA", F.col("n")).otherwise(0))
    return a.unionByName(cat.groupBy("variable").agg((gone * F.lit(100.0) / F.sum("n")).alias("missing")))


def report(df: DataFrame, strat: str, variables: Sequence[str], always_categorical: Sequence[str] = (),
           keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Printable Table One: rows 'n', '<var> (mean (SD))' and '<var> (%) = <level>',
    one column per stratum (values rounded, then formatted), and the SMD and the
    missing share (percent) of the row's variable.

    A variable is categorical if it is a string, holds only 0, 1 and null, or is
    named in ``always_categorical``. ``keep`` picks from (variable, smd) the
    variables to print. Strata become columns with a pivot over their distinct
    values, of which there are at most ``MOST_LEVELS``."""
    as_levels = set(categorical_columns(df, list(variables))) | set(always_categorical)
    cont = continuous(df, strat, [v for v in variables if v not in as_levels])
    cat = categorical(df, strat, [v for v in variables if v in as_levels])
    sizes = df.groupBy(c(strat).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    smd = smds(cont, cat)

    def fmt(x, spec):
        return F.when(x.isNull(), F.lit("NA")).otherwise(F.format_string(spec, x))

    long = (cont.select(F.concat(F.col("variable"), F.lit(" (mean (SD))")).alias("row"), "variable",
                        "stratum", F.concat(fmt(F.round("mean", 2), "%.2f"), F.lit(" ("),
                                            fmt(F.round("sd", 2), "%.2f"), F.lit(")")).alias("cell"))
            .unionByName(cat.select(F.concat(F.col("variable"), F.lit(" (%) = "), F.col("level")).alias("row"),
                                    "variable", "stratum",
                                    F.concat(F.format_string("%d", F.col("n")), F.lit(" ("),
                                             F.format_string("%.1f", F.round("pct", 1)), F.lit(")")).alias("cell"))))
    if keep is not None:
        long = long.join(keep(smd).select("variable"), "variable", "left_semi")
    long = long.unionByName(sizes.select(F.lit("n").alias("row"), F.lit("").alias("variable"), "stratum", F.col("n").cast("string").alias("cell")))
    strata = [s for s in levels(sizes, "stratum") if s is not None]
    wide = long.groupBy("row", "variable").pivot("stratum", strata).agg(F.first("cell"))
    beside = smd.join(missing_shares(cont, cat), "variable").select(
        "variable", F.when(F.col("smd").isNotNull(), F.format_string("%.3f", F.round("smd", 3))).alias("SMD"),
        F.format_string("%.1f", F.round("missing", 1)).alias("Missing"))
    return wide.join(beside, "variable", "left").select("row", "variable", *[F.col(f"`{s}`") for s in strata], "SMD", "Missing")
