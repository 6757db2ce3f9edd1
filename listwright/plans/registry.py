"""Queries of the listings engine and their SQL."""

from __future__ import annotations

from . import board_payloads, indexes, listings, maintenance, model, sources_and_text, updates  # noqa: F401  (they register their queries)
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
