"""Queries by name, and their SQL, collected from the query modules."""

from __future__ import annotations

from drawlake.plans import q_data, q_diag, q_model, q_state  # noqa: F401  (they register themselves)
from drawlake.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "p9_score"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
