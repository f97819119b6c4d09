"""Queries over the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from sessionweave.plans import log_queries  # noqa: F401 (adds its queries)
from sessionweave.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
