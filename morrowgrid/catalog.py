"""All queries of the library and their SQL."""

from __future__ import annotations

from .plans import audits, models, reports, scores, shapes  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
