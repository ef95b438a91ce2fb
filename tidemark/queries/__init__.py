"""Named queries over the driver's tables, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from . import audit, books, cases, checks, features, frames, long, models, research, reviews, rules, tables, warehouse  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
