"""Queries that bind the operators to the tables, each with its SQL where SQL can express it."""

from . import audit_queries, disparity_queries, entity_queries, label_queries, list_queries, match_queries, mining_queries, scalar_queries, scoring_queries, series_queries, value_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
