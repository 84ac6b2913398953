"""Ordered rewrite rules as data, applied as native column expressions.

Rules are ``(pattern, replacement)`` pairs applied in order, so later rules
see the output of earlier ones — the same contract as a chain of ``gsub``.
They compile to nested ``regexp_replace`` / ``CASE WHEN rlike`` expressions;
nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

# ---------------------------------------------------------------------------
# Model-name clean-up rules per source (pattern -> replacement),
# in the order the reference applies them.
# ---------------------------------------------------------------------------
MODEL_CLEAN_RULES: dict[str, list[Rule]] = {
    "med_helm": [("databricks-", ""), ("-rag", "-multi")],
    "rubric": [("-enhanced-prompt", "-prompt"),
               ("-prompt-completeness-3", "-prompt2"),
               ("-prompt-context-awareness", "-prompt3")],
    "badges": [("_choose_best", "-alexandria_p")],
    "cases": [("meta-llama/", "")],
}

# Canonical model names (regex -> name), applied in order;
# a later rule sees the output of the earlier ones.
CANONICAL_MODEL_RULES: list[Rule] = [
    ("llama3_1|llama-3.1-8b", "Llama 3.1 8b"),
    ("llama-3.3-70b|llama3_3", "Llama 3.3 70B"),
    ("llama_mav4|llama-4-maverick", "Llama 4 Maverick"),
    ("llama_scout4|llama-4-scout", "Llama 4 Scout"),
    ("o3", "o3"),
    ("gpt5", "gpt5"),
]

# Improvement tags in time order, and the digit suffixes a tag may carry.
IMPROVEMENT_TAGS = ["-rag", "-prompt", "-multi", "-alexandria_p"]
IMPROVEMENT_PATTERN = "(" + "|".join(IMPROVEMENT_TAGS) + ")[1-5]?$"

# Ordered column-rename rules of the cohort extract.
COLUMN_RENAME_RULES: list[Rule] = [
    ("comorb_", "cci_"),
    ("baseline_baseline", "baseline"),
    (r"\.prior|followup\.|\.followup|\.disorder|_bin|_cont|_disc", ""),
    (r"blood\.pressure", "bp"),
    ("baseline_comorb", "baseline"),
    ("inpatient", "ip"),
    ("baseline_prior|baseline_scores", "baseline"),
    (r"number\.of", "prior.med"),
    (r"\.previously", ""),
    ("grps", "groups"),
    (r"\.3m", ".03m"),
    (r"\.6m", ".06m"),
]
# Horizon suffixes moved to the end of a name, then the outcome prefix.
HORIZON_SUFFIX_RULES: list[Rule] = [("_3mo", ".03mo"), ("_6mo", ".06mo"), ("_12mo", ".12mo")]
OUTCOME_PREFIX_RULE: Rule = (r"outcome\.", "outcome_")

# Ordered recode of the intervention category.
INTERVENTION_RECODE_RULES: list[Rule] = [
    (r"INTERVENTION_||\.ANTIPSYCHOTIC", ""),
    ("REF_", "."),
    ("ARIPIPRAZOLE|ABILIFY", "ARI"),
    (r"PALIPERIDONE\.", "PP"),
    ("LONG.ACTING", "LAI"),
    ("ARI.ASIMTUFII", "Ari2MRTU"),
    ("ARI.MAINTENA", "AOM"),
    ("NON.ARI.LAI", "LAI.Other"),
    ("ARI.LAUROXIL", "LAI.Ari.Laur"),
    ("ARI.ORAL", "Oral.Ari"),
    ("CLOZAPINE", "Clozapine"),
    ("ATYPICAL.NON.ARI", "Oral.Atyp.Other"),
    ("TYPICAL", "Typical"),
    ("ATypical", "Atypical"),
]


def apply_replace_rules(col: Column, rules: Sequence[Rule]) -> Column:
    """Chain of regex replace-all rules, in order."""
    out = col
    for pattern, repl in rules:
        out = F.regexp_replace(out, F.lit(_java_pattern(pattern)), F.lit(_java_repl(repl)))
    return out


def resolve_assign_rules(rules: Sequence[Rule]) -> list[Rule]:
    """Collapse a cascade of whole-value assignments into first-match rules.

    ``x[grep(p_i, x)] <- name_i`` applied in order means a later rule tests
    the *name* an earlier rule wrote. Because names are constants, the final
    value for "rule i is the first to match" is known on the driver, so the
    cascade becomes one linear CASE (no expression blow-up).
    """
    out = []
    for i, (pattern, name) in enumerate(rules):
        final = name
        for later_pattern, later_name in rules[i + 1:]:
            if re.search(later_pattern, final):
                final = later_name
        out.append((pattern, final))
    return out


def apply_assign_rules(col: Column, rules: Sequence[Rule], otherwise: Column | None = None) -> Column:
    """``x[grep(p, x)] <- name`` in order (later rules see earlier output)."""
    resolved = resolve_assign_rules(rules)
    expr = None
    for pattern, final in resolved:
        cond = col.rlike(pattern)
        expr = F.when(cond, F.lit(final)) if expr is None else expr.when(cond, F.lit(final))
    fallback = col if otherwise is None else otherwise
    return fallback if expr is None else expr.otherwise(fallback)


def rename_columns(names: Sequence[str]) -> list[str]:
    """Driver-side fold of the cohort rename rules over column names."""
    out = []
    for name in names:
        n = name.lower()
        for pattern, repl in COLUMN_RENAME_RULES:
            n = re.sub(_py_pattern(pattern), repl, n)
        for pattern, suffix in HORIZON_SUFFIX_RULES:
            if re.search(pattern, n):
                n = re.sub(pattern, "", n) + suffix
        n = re.sub(OUTCOME_PREFIX_RULE[0], OUTCOME_PREFIX_RULE[1], n)
        out.append(n)
    dupes = {n for n in out if out.count(n) > 1}
    if dupes:
        raise ValueError(f"rename rules produce duplicate columns: {sorted(dupes)}")
    return out


def _java_pattern(p: str) -> str:
    # An empty alternative ("a||b") matches the empty string in both engines;
    # drop it so the rule only removes the named parts.
    return p.replace("||", "|")


def _py_pattern(p: str) -> str:
    return p.replace("||", "|")


def _java_repl(r: str) -> str:
    # "$" and "\" are special in Java replacement strings.
    return r.replace("\\", "\\\\").replace("$", "\\$")


def replace_rules_sql(expr: str, rules: Sequence[Rule]) -> str:
    """DuckDB twin of :func:`apply_replace_rules` (global replace)."""
    out = expr
    for pattern, repl in rules:
        out = f"regexp_replace({out}, '{_sql_escape(_java_pattern(pattern))}', '{_sql_escape(repl)}', 'g')"
    return out


def assign_rules_sql(expr: str, rules: Sequence[Rule], otherwise: str | None = None) -> str:
    whens = " ".join(f"WHEN regexp_matches({expr}, '{_sql_escape(p)}') THEN '{_sql_escape(v)}'"
                     for p, v in resolve_assign_rules(rules))
    return f"(CASE {whens} ELSE {otherwise or expr} END)"


def _sql_escape(s: str) -> str:
    return s.replace("'", "''")
