"""Every named query over the reference operators, with its SQL twin."""

from __future__ import annotations

from .plans import diffing, feeding, reconciling, watching  # noqa: F401  they register their queries
from .plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
