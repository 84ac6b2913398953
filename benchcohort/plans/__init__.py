"""Query catalogue: importing this package registers every query."""

from . import q_cohort, q_models, q_report, q_rubric, q_scorecard, q_sources, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
