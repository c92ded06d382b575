"""The query catalogue: one entry per operator family, with its oracle SQL."""

from __future__ import annotations

from quillframe.plans import contracts, curation, evaluation, manifests, signals  # noqa: F401
from quillframe.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
