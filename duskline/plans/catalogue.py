"""The catalogue of queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import applied, decisions, delivered, matched, reads, rollups, sinks, structured, texts, windows  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
