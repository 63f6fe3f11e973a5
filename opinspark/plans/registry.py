"""All registered queries with their DuckDB text."""

from __future__ import annotations

from . import catalogue, judging, models, profiles, texts  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
