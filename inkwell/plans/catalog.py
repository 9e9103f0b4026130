"""All registered queries of the search engine and their SQL twins."""

from __future__ import annotations

from . import flows, scalars, searches  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
