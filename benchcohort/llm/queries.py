"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .q_bpe import op2_bpe
from .q_classify import op6_quality, op7_language
from .q_importance import op12_importance_resampling
from .q_mixing import OP8_SQL, op8_mix_sources
from .q_neardup import op9_near_duplicates
from .q_periodic import op13_periodic_runs
from .q_simhash import op11_simhash_duplicates
from .q_substring import op1_substring_dedup
from .q_tokencount import op3_token_counts
from .q_urlfilter import OP4_SQL, op4_url_filter
from .q_vectors import OP10_SQL, op5_rotated_codes, op10_voronoi_top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_rotated_codes": op5_rotated_codes,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_mix_sources": op8_mix_sources,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_voronoi_top_k": op10_voronoi_top_k,
    "op11_simhash_duplicates": op11_simhash_duplicates,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": OP4_SQL,
    "op8_mix_sources": OP8_SQL,
    "op10_voronoi_top_k": OP10_SQL,
}
