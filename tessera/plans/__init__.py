"""Named queries (Spark builders + DuckDB oracle SQL), one per operator of the survey."""

from . import q_io, q_labels, q_positions, q_reps, q_runs, q_scoring, q_text, q_tokens  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
