"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from kinfold.plans import extra_queries, more_queries, pair_queries, text_queries
from kinfold.plans.pair_queries import flagship
from kinfold.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "extra_queries", "flagship", "more_queries", "pair_queries", "text_queries"]
